"""Scans, table aliases and column names."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.schema import CANONICAL_NAMES, DISPLAY_NAMES, TABLE_ALIASES


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row under an explicit schema; nothing is inferred."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", escape='"')


def scan_table(
    spark: SparkSession,
    path: str,
    start: date | None = None,
    end: date | None = None,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
) -> DataFrame:
    """Whole table, or its deals sold from one date to another (both included); either may be unset.

    The dates reach the file scan; on a table written by :func:`dealspan.sources.sinks.write_deals`
    they also skip whole years.
    """
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    by_year = "sold_year" in df.columns
    if start:
        df = df.filter(F.col("sold_date") >= F.lit(start))
        df = df.filter(F.col("sold_year") >= start.year) if by_year else df
    if end:
        df = df.filter(F.col("sold_date") <= F.lit(end))
        df = df.filter(F.col("sold_year") <= end.year) if by_year else df
    return df


def scan_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents without their internal ``_id`` field."""
    return spark.read.schema(schema).json(path).drop("_id")


def physical_name(name: str) -> str:
    """Table behind a logical name; an unknown name stands for itself."""
    return TABLE_ALIASES.get(name, name)


def register(name: str, df: DataFrame) -> None:
    df.createOrReplaceTempView(physical_name(name))


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(physical_name(name))


def to_display_names(df: DataFrame) -> DataFrame:
    """Canonical names to the headers of the export; other columns keep their name."""
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


def to_canonical_names(df: DataFrame) -> DataFrame:
    """Headers of the export to canonical names; other columns keep their name."""
    return df.withColumnsRenamed({k: v for k, v in CANONICAL_NAMES.items() if k in df.columns})


def load_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that have at least one row."""
    return {name: df for name, df in tables.items() if not df.isEmpty()}


def preview(df: DataFrame, n: int = 5, order: Iterable[str] = ()) -> DataFrame:
    """First ``n`` rows, in a given order if one is named."""
    keys = list(order)
    return (df.orderBy(*keys) if keys else df).limit(n)


def with_columns_present(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the schema's missing columns as typed nulls, so reports yield empty results."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(absent) if absent else df


def require_column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise ValueError(f"no column {name!r} in the table")
    return df
