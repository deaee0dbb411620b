"""Registered queries against their SQL, the native ones' plans, and the pipeline against its operators."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dealspan.llm import decontam, workload
from dealspan.llm.simhash import near_duplicates
from workload.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = workload.queries(), workload.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, CHECKS[name])[0] == ""


def test_native_operators_use_no_python(spark):
    from dealspan.llm import linededup

    plan = linededup.dedup_lines(workload.table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_pipeline_stages(spark):
    docs, seen = workload.table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SF).cache()
        assert new.columns == docs.columns
        assert new.join(docs, "doc_id", "left_anti").count() == 0
        if name == "simhash_near_dedup":
            assert new.count() == near_duplicates(docs).select("component_id").distinct().count()
        if name == "benchmark_decontamination":
            items = workload.table(spark, SF, "benchmark")
            assert decontam.contained_items(new, items).count() == 0
            assert docs.join(new, "doc_id", "left_anti").count() == decontam.contained_items(docs, items).select("doc_id").distinct().count()
        seen.append(new.count())
        docs = new
    assert seen[0] == seen[1] and seen == sorted(seen, reverse=True)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_odd_rows(spark, odd_documents, tmp_path):
    docs = odd_documents.withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 7} <= set(ids) and 11 not in ids


def test_pipeline_judges_rows_and_not_ids(spark):
    toxic = [r.doc_id for r in workload.op1_toxicity(spark, SF).filter("rejected").orderBy("doc_id").limit(1).collect()]
    given = workload.table(spark, SF, "documents")
    bad = given.filter(F.col("doc_id") == toxic[0]).first().text
    item = " ".join(["before", workload.table(spark, SF, "benchmark").first().text, "after"])
    rows = [(None, bad), (None, "clean words of the first row"), (7, bad), (7, "other clean words for the seventh document")]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    left = lambda df: sorted((r.doc_id or 0, r.text) for r in df.collect())
    judged = corpus_pipeline.without_toxic(spark, given.select("doc_id", "text").union(frame([(i and i + 10**9, t) for i, t in rows])), SF)
    new = judged.filter(f"doc_id is null or doc_id > {10**9}")
    assert left(new) == [(0, rows[1][1]), (7 + 10**9, rows[3][1])]
    rows = [(2, None), (None, None), (None, "no id here at all"), (None, "another text without any id"), (3, "one text of the third"), (3, "and something else entirely"), (4, "one text of the third")]
    kept = corpus_pipeline.without_near_duplicates(spark, frame([*rows, rows[4]]), SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(2, ""), *((i or 0, t) for i, t in rows[2:6])])
    rows = [(None, item), (None, "clean"), (7, item), (7, "clean too")]
    assert left(corpus_pipeline.without_benchmark(spark, frame(rows), SF)) == [(0, "clean"), (7, "clean too")]
