"""Tables whose readers see whole writes only: loads behind a commit marker, and upserts that replace single files.

A table is a folder with ``_data``, where every write has a folder of its own, and ``_marks``, small files that name what
is valid. A write becomes visible by its mark alone, which appears at once; data of a failed write is never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.operators.ranking import best_per_key

_TABLE = "table"


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, path = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _mark(spark: SparkSession, table: str, key: str, number: int, entry: dict) -> None:
    """Names a write as valid. Fails if another writer was there first, so that no write is lost."""
    folder = f"{table}/_marks/{quote(key, safe='')}"
    fs, target = _at(spark, f"{folder}/{number:010d}")
    _, draft = _at(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"{table} was written by someone else meanwhile")


def _valid(spark: SparkSession, table: str, key: str) -> tuple[int, dict | None]:
    """The number of the last mark and what it names."""
    folder = f"{table}/_marks/{quote(key, safe='')}"
    numbers = [n for n in _names(spark, folder) if not n.startswith(".")]
    if not numbers:
        return 0, None
    fs, path = _at(spark, f"{folder}/{max(numbers)}")
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return int(max(numbers)), json.loads(text)


def commit_load(df: DataFrame, table: str, load_id: str, valid: Column | None = None) -> None:
    """Writes one load and its rejected rows in one pass; under a known ``load_id`` it replaces that load.

    Rows that fail ``valid``, or for which it is unknown, are rejected. A reader sees the load as it was before or as it is
    now, accepted and rejected rows together; a load of no rows replaces as well.
    """
    if {"load_id", "rejected"} & set(df.columns):
        raise ValueError("load_id and rejected are columns of the stored table")
    spark = df.sparkSession
    number, _ = _valid(spark, table, load_id)
    folder = f"{table}/_data/{uuid.uuid4().hex}"
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    marked = df.withColumns({"load_id": F.lit(load_id), "rejected": ~ok})
    marked.write.partitionBy("rejected").parquet(folder)
    schema = marked.drop("rejected").schema.json()
    _mark(spark, table, load_id, number + 1, {"data": folder, "schema": schema})


def read_loads(spark: SparkSession, table: str, rejected: bool = False) -> DataFrame:
    """Rows of all loads with their ``load_id``: the accepted ones, or the rejected ones."""
    found = [_valid(spark, table, unquote(key))[1] for key in _names(spark, f"{table}/_marks")]
    found = [entry for entry in found if entry]
    if not found:
        raise ValueError(f"no load in {table}")
    schemas = {entry["schema"] for entry in found}
    if len(schemas) > 1:
        raise ValueError(f"loads of {table} differ in their columns")
    schema = T.StructType.fromJson(json.loads(schemas.pop()))
    part = f"rejected={str(rejected).lower()}"
    folders = [f"{entry['data']}/{part}" for entry in found if part in _names(spark, entry["data"])]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(incoming: DataFrame, table: str, keys: Sequence[str], latest: Sequence[Column]) -> None:
    """Merges a load by key; only files that hold one of its keys are written again.

    The latest row of each incoming key is computed and written once, as files of the new version. Their keys alone are
    compared with the keys of the table; files without a match stay as they are and are named by the new version,
    files with one are written without those rows. Rows without a key drop out. The first load makes the table.
    """
    spark = incoming.sparkSession
    number, entry = _valid(spark, table, _TABLE)
    newest = best_per_key(incoming.dropna(subset=list(keys)), keys, latest)
    if entry:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        newest = newest.select([F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    folder = f"{table}/_data/{uuid.uuid4().hex}"
    newest.write.parquet(f"{folder}/new")
    files = list(entry["files"]) if entry else []
    if files:
        fresh = spark.read.schema(newest.schema).parquet(f"{folder}/new").select(*keys)
        stored = spark.read.schema(newest.schema).parquet(*files)
        hits = stored.select(*keys, "_metadata.file_name").join(fresh, list(keys), "left_semi")
        names = {r.file_name for r in hits.select("file_name").distinct().collect()}  # at most one for each file
        # a file's name has the id of the write that made it, so no two files of a table share one
        old = [f for f in files if f.rsplit("/", 1)[1] in names]
        if old:
            stored = spark.read.schema(newest.schema).parquet(*old)
            stored.join(fresh, list(keys), "left_anti").write.parquet(f"{folder}/kept")
        files = [f for f in files if f.rsplit("/", 1)[1] not in names]
    made = [f"{folder}/{part}/{n}" for part in ("new", "kept") for n in _names(spark, f"{folder}/{part}") if n.endswith(".parquet")]
    _mark(spark, table, _TABLE, number + 1, {"files": files + made, "schema": newest.schema.json()})


def table_files(spark: SparkSession, table: str) -> list[str]:
    """The files of an upserted table's valid version."""
    _, entry = _valid(spark, table, _TABLE)
    return entry["files"] if entry else []


def read_upserted(spark: SparkSession, table: str) -> DataFrame:
    """The valid version of an upserted table."""
    _, entry = _valid(spark, table, _TABLE)
    if not entry:
        raise ValueError(f"no upserted table at {table}")
    schema = T.StructType.fromJson(json.loads(entry["schema"]))
    return spark.read.schema(schema).parquet(*entry["files"]) if entry["files"] else spark.createDataFrame([], schema)
