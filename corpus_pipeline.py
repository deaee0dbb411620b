"""From raw documents to packed sequences: filtering, line and document deduplication, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspan.llm import decontam, linededup, simhash, toxicity
from dealspan.llm.common import Scratch
from dealspan.llm.workload import packed, reachable, table

#: The classifier is trained, so SQL cannot give the rows.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> Column:
    """A row of ``docs`` as one value, so that no name of its columns meets one that a stage uses."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject, each row judged by its own text.

    Null, empty and very long texts and repeated rows are judged like all others; a text without letters is kept. Rows go
    through the classifier with all their columns, so that none is joined back. No documents give no documents.
    """
    reachable(spark)
    labels = toxicity.quality_and_toxicity(table(spark, sf_dir, "labels"))
    rest = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    judged = toxicity.toxic_documents(docs, labels, carry={"document": rest}, carry_text="text")
    whole = ["text" if c == "text" else f"document.`{c}`" for c in docs.columns]
    return judged.filter(~F.col("rejected")).select(*whole)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line passages; no row goes.

    A null text stays null, and a text may become empty. Rows equal in id and text come out alike. All columns are kept;
    ``n_chars``, where there is one, becomes the length of the text left.
    """
    return linededup.without_repeated_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id (null last), then the smallest hashes of its text and row.

    Null texts, empty ones and others without words are near duplicates of each other. Of rows equal in all columns one stays. Texts are
    compared as a whole, however long. No documents give no documents.
    """
    reachable(spark)
    keys = ["text_low", "text_high", "row_low", "row_high"]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marks = [*columns, *(c.isNull() for c in columns)]  # the hash alone passes over nulls
    hashes = [F.xxhash64("text"), F.xxhash64("text", F.lit(1)), F.xxhash64(*marks), F.xxhash64(*marks, F.lit(1))]
    own = docs.select(_whole(docs).alias("document"), *(h.alias(k) for h, k in zip(hashes, keys, strict=True)))
    row = F.struct(F.col("document.doc_id").isNull().alias("late"), F.col("document.doc_id").alias("doc_id"), *keys)
    found = simhash.near_duplicates(own.select(row.alias("row"), "document.text"), id_col="row")
    kept = found.filter(F.col("row") == F.col("component_id")).select(*(f"row.{k}" for k in keys)).distinct()
    return own.join(kept, keys, "left_semi").dropDuplicates(keys).select("document.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each row judged by its own text.

    Null and empty texts hold none. Very long texts are searched as a whole. Repeated rows go or stay together, and all columns
    are kept. No documents give no documents.
    """
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null text is packed like an empty one, texts over a sequence are cut into pieces, and repeated rows are documents of their own.
    """
    reachable(spark)
    return packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", into_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir))
