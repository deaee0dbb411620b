"""Columns of any name, repeated rows, empty tables and short items through the operators and the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dealspan.llm import decontam, linededup, workload

SF = "/root/testdata/sf0.001"
NAMES = "text_low text_high row_low row_hash removed lines text_key own_id n_lines n_removed rejected p_toxic document row late label0 begin stop".split()


def _with_names(docs):
    """Columns that carry the row's number, under names that stages might use."""
    return docs.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in NAMES})


def test_stages_keep_columns_of_any_name(spark, odd_documents):
    docs = odd_documents.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    docs = _with_names(docs.union(workload.table(spark, SF, "documents").filter("doc_id between 100 and 160").select(docs.columns)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES], name
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{'' if r.doc_id is None else r.doc_id}" for r in rows for n in NAMES), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_no_documents(spark):
    docs = workload.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def _deduped(docs, width):
    """Texts without the lines of later windows, by marking line after line."""
    seen, gone = {}, {}
    order = sorted({d for d in docs if d[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    for doc in order:
        lines, marks = doc[1].split("\n"), set()
        for i in range(len(lines) - width + 1):
            window = tuple(lines[i : i + width])
            if not any(x.strip(" \t\r") for x in window):
                continue
            first = seen.setdefault(window, (doc, i))
            if first != (doc, i):
                marks |= {x for x in range(i, i + width) if first[0] != doc or x >= first[1] + width}
        gone[doc] = marks
    keep = lambda d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d])
    return sorted(((d[0], keep(d) if d[1] is not None else None, len(gone.get(d, ()))) for d in docs), key=str)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_lines_against_brute_force(spark, width):
    rng = random.Random(width)
    docs = [(i, "\n".join(rng.choices(["a", "b", "c", "", " ", "d\r"], k=rng.randrange(25)))) for i in range(60)]
    docs += [(None, "n\no\ni\nd"), (70, None), (71, "n\no\ni\nd"), (72, "\n".join(f"x{i}" for i in range(5000))), (73, "\n".join(f"x{i % 4990}" for i in range(5000)))]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, removed string, text_key string")
    got = linededup.dedup_lines(frame, width).collect()
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got), key=str) == _deduped(docs, width)
    assert all(r.removed == "x" and r.text_key == "y" for r in got)


def test_texts_of_very_many_lines(spark):
    lines = [f"line {i}" for i in range(60_000)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(x if i % 7 else f"other {i}" for i, x in enumerate(lines)))]
    rows = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1].text == docs[0][1] and rows[2].text.split("\n")[:2] == ["other 0", "other 7"]
    assert rows[2].n_lines == 60_000 and rows[2].n_removed + len(rows[2].text.split("\n")) == 60_000


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "say One, two three four!"), (2, "one two three"), (3, "two"), (4, None), (5, "one two and three four five six seven")], "doc_id long, text string")
    items = [(10, "one two three four"), (11, "TWO"), (12, "and three"), (13, "four three"), (14, ""), (15, "and three four five six")]
    found = decontam.contained_items(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item, r.share) for r in found} == {
        (1, 10, 1, 1, 1.0), (1, 11, 1, 1, 1.0), (2, 11, 1, 1, 1.0), (3, 11, 1, 1, 1.0), (5, 11, 1, 1, 1.0), (5, 12, 1, 1, 1.0), (5, 15, 1, 1, 1.0),
    }
