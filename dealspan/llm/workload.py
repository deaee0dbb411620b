"""The operators' registered queries: each applies one of them, with its parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealspan.llm import (
    annforest, chat, collocations, decontam, fptree, hmm, langid, linededup, packing, phrases, simhash, sql_checks, toxicity, urlfilter,
)

TOKENIZER = "word_bpe_49k.json"
_ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Lets Python workers that run on this machine import the package, wherever the driver was started."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's probabilities and whether it is rejected as toxic."""
    labels = toxicity.quality_and_toxicity(table(spark, sf_dir, "labels"))
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), labels)


def packed(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    return packing.pack_documents(docs, path, carry={"ids_crc32": F.crc32("ids")})


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packed(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest id that near duplicates lead to."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, learned from those with crc32(doc_id) mod 4 other than 2."""
    held_out = "pmod(crc32(coalesce(cast(doc_id as string), '')), 4) = 2"
    return langid.predict_languages(table(spark, sf_dir, "documents"), held_out)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule and verdict."""
    return urlfilter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability, learned from those with crc32(doc_id) mod 10 other than 0."""
    held_out = "pmod(crc32(coalesce(cast(doc_id as string), '')), 10) = 0"
    return hmm.score_texts(table(spark, sf_dir, "documents"), held_out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words, removed words and the hash of those kept."""
    return phrases.remove_recurring(table(spark, sf_dir, "documents"), carry={"kept_sha256": F.sha2("text", 256)})


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without repeated three-line passages."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found to each vector whose id is divisible by 100."""
    return annforest.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def chat_digest(examples: DataFrame) -> DataFrame:
    """What can be read back from a conversation's examples: its turns from the closing one, the text under the spans from all."""
    turns, said = chat.read_turns(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    closing = F.when(F.col("closes"), F.sha2(F.array_join(F.transform(turns, said), ""), 256))
    n_turns = F.when(F.col("closes"), F.size(turns)).cast("long")
    each = examples.select("conv_id", "example", n_turns.alias("n"), closing.alias("turns"), chat.read_loss(examples).alias("loss"), F.length("text").alias("chars"))
    losses = F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss"))))
    out = each.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("turns").alias("turns_sha256"), F.coalesce(F.sum(F.length("loss")), F.lit(0).cast("long")).alias("loss_chars"),
        losses.alias("losses"), F.sum("chars").alias("formatted_chars"),
    )
    return out.withColumn("loss_sha256", F.sha2(F.array_join(F.col("losses.loss"), ""), 256)).drop("losses")


def op11_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each conversation, and of one whose texts are control strings, as its examples give them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn, role = F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    tricky = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn, role, F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digest(chat.prefix_examples(turns.union(tricky)))


def op12_document_fptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return fptree.best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words in each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_toxicity, op2_best_fit_packing, op3_simhash_near_dedup, op4_language_id, op5_url_filter, op6_hmm_scores,
    op7_substring_dedup, op8_line_dedup, op9_decontamination, op10_hash_prefix_forest, op11_prefix_targets, op12_document_fptree,
    op13_phrase_collocations,
)


def _query(operator: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        reachable(spark)
        return operator(spark, sf_dir)

    run.__name__, run.__doc__ = operator.__name__, operator.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {op.__name__: _query(op) for op in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return sql_checks.checks()
