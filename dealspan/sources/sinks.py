"""Writing tables: keyed upsert, appends, repeatable loads, row numbers and CSV."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from dealspan.operators.ranking import best_per_key
from dealspan.session import shared_dir

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its lower 33 bits


def upsert(
    current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], latest: Sequence[Column]
) -> DataFrame:
    """Current rows without the incoming keys, plus the latest incoming row of each key.

    Rows without a key drop out. The current table is filtered with an anti join on the distinct
    incoming keys and not regrouped, so a small load does not shuffle a large table.
    """
    keyed = incoming.dropna(subset=list(keys))
    newest = best_per_key(keyed, keys, latest)
    if current is None:
        return newest
    kept = current.join(keyed.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(newest)


def write_upsert(
    spark: SparkSession, current_path: str | None, incoming: DataFrame,
    keys: Sequence[str], latest: Sequence[Column], new_path: str,
) -> None:
    """Write the merged table to a new directory; the current one stays readable."""
    if current_path == new_path:
        raise ValueError("the merged table needs a directory of its own")
    current = spark.read.parquet(current_path) if current_path else None
    upsert(current, incoming, keys, latest).write.mode("overwrite").parquet(new_path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_deals(deals: DataFrame, path: str) -> None:
    """Deals by sold year, range-partitioned by date so that files cover narrow date ranges.

    ``listing_id`` splits a date that holds a large part of the rows over several tasks. Years of an
    earlier table at ``path`` go, whatever the session's overwrite mode is.
    """
    (
        deals.withColumn("sold_year", F.year("sold_date"))
        .repartitionByRange("sold_date", "listing_id")
        .sortWithinPartitions("sold_year", "sold_date")  # the order the writer asks for
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("sold_year")
        .parquet(path)
    )


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Unique increasing row id with gaps; no shuffle."""
    return df.withColumn(name, F.monotonically_increasing_id())


def with_row_number(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Row number 0, 1, 2, ... in the given order, without gathering the rows in one task.

    A range sort places the rows; their partition and position are frozen by a checkpoint, so a
    lost executor cannot renumber them. One start offset per partition is then joined back: the
    broadcast has as many rows as the shuffle has partitions.
    """
    shared_dir(df.sparkSession)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", position)
        .checkpoint()
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = placed.join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, (F.col("_start") + F.col("_pos")).alias(name))


#: So many files may have their first numbers broadcast, about 10 MB.
MOST_FILES = 100_000


def with_file_row_number(spark: SparkSession, path: str, name: str = "row_index") -> DataFrame:
    """Rows of a Parquet table with their number 0, 1, 2, ... in the order of the files and of the rows in them.

    The place in a file comes from the file itself and only the rows per file are counted, so no row is moved or copied.
    Files are in order by path, as Spark names the parts of a sorted table.
    """
    stored = spark.read.parquet(path)
    file, at, start = (_free(stored, c) for c in ("file", "at", "start"))
    placed = stored.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    sizes = placed.groupBy(file).agg((F.max(at) + 1).alias(at))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(file, F.coalesce(F.sum(at).over(before), F.lit(0)).alias(start))
    few = len(stored.inputFiles()) <= MOST_FILES
    joined = placed.join(F.broadcast(starts) if few else starts, file)
    return joined.select(*(joined[f"`{c}`"] for c in stored.columns), (F.col(start) + F.col(at)).alias(name))


def _free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def with_batches(df: DataFrame, order: Sequence[str], size: int = 500) -> DataFrame:
    """Consecutive batches of a fixed size: ``row_index`` and 1-based ``batch_id``."""
    numbered = with_row_number(df, order)
    return numbered.withColumn("batch_id", F.floor(F.col("row_index") / size) + 1)


def split_rejects(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass the check and rows that fail it; an unknown result fails."""
    ok = F.coalesce(valid, F.lit(False))
    return df.filter(ok), df.filter(~ok)


def write_load(
    df: DataFrame, path: str, load_id: str, valid: Column | None = None, rejects: str | None = None
) -> None:
    """Append one load under its own partition; running it again replaces that partition only.

    Rows failing ``valid`` go to the ``rejects`` directory under the same load.
    """
    good, bad = split_rejects(df, valid) if valid is not None else (df, None)
    _write_partition(good, path, load_id)
    if bad is not None and rejects is not None:
        _write_partition(bad, rejects, load_id)


def _write_partition(df: DataFrame, path: str, load_id: str) -> None:
    # A directory for each load, so that a load without rows also replaces what was there.
    folder = f"{path.rstrip('/')}/load_id={quote(load_id, safe='-_. ')}"
    df.write.mode("overwrite").parquet(folder)


def write_parallel(df: DataFrame, path: str, tasks: int | None = None) -> None:
    """Write with a chosen number of parallel tasks; by default one per input partition."""
    (df.repartition(tasks) if tasks else df).write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. ``single_file`` is for results of a known small size."""
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    writer.csv(path, header=True, escape='"')


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table for several reports and release it when the block ends.

    Blocks lost with an executor are computed again. What is read behind the block is computed anew.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist(blocking=True)
