"""Schema discovery: declared keys and the attributes with values, over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type codes of stored attributes.
TEXT, NUMBER, BOOLEAN, NULL, LIST, MAP = "S", "N", "BOOL", "NULL", "L", "M"

#: Text that is no item: not JSON, or JSON but not an object.
INVALID = "INVALID"
#: One bit for each kind of value, so that kinds seen by different tasks merge by ``bit_or``; the order they are shown in.
_KINDS = (BOOLEAN, LIST, MAP, NUMBER, TEXT, INVALID)


def type_code(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return NUMBER
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, T.NullType):
        return NULL
    if isinstance(dtype, T.ArrayType):
        return LIST
    if isinstance(dtype, (T.MapType, T.StructType)):
        return MAP
    return TEXT


def _variant_code(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", NULL)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind.startswith("ARRAY"), LIST)
        .when(kind.startswith("OBJECT"), MAP)
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), NUMBER)
        .otherwise(TEXT)
    )


def _sampled(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """All rows, or the first ``n``: in a given order, which reads the table, or as stored."""
    if n is None:
        return df
    return (df.orderBy(*order) if order else df).limit(n)


def table_profile(
    df: DataFrame, name: str, keys: Sequence[str] = (), order: Sequence[str] = (),
    sample: int | None = None,
) -> DataFrame:
    """Attributes of one table: its keys, then the columns with a value anywhere, and how many values.

    All columns are counted in one pass whose partial result is one row a task. ``sample`` looks at so many rows only.
    """
    counts = [F.count(F.col(f"`{f.name}`")).alias(f"_{i}") for i, f in enumerate(df.schema)]
    cells = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(f.name).alias("attribute"),
            F.lit(type_code(f.dataType)).alias("type"),
            F.lit(f.name in keys).alias("is_key"),
            F.col(f"_{i}").alias("n_values"),
        )
        for i, f in enumerate(df.schema)
    ]
    # Keys come from the declaration, so an empty table still lists them.
    found = _sampled(df, order, sample).agg(*counts).select(F.inline(F.array(*cells)))
    return found.filter(F.col("is_key") | (F.col("n_values") > 0))


def item_profile(
    df: DataFrame, json_column: str, order: Sequence[str] = (), sample: int | None = None
) -> DataFrame:
    """Attributes inside a JSON text column: ``attribute``, ``type``, ``n_items`` and ``n_nulls``.

    Every item is read. ``type`` names all kinds that an attribute's values have, such as ``N|S``; ``NULL`` only if it
    never has a value. ``n_items`` counts the items that have the attribute, ``n_nulls`` those where it is null. Text that is
    not an object is counted under a null attribute as ``INVALID``; a null text is no item. The kinds are bits, so the aggregate has a
    fixed width and each task sends one row for each attribute. ``sample`` looks at so many items only.
    """
    text = _sampled(df.select(*order, json_column), order, sample).select(F.col(json_column).alias("_text")).dropna()
    parsed = text.select(F.try_parse_json("_text").alias("_any"))
    is_item = F.coalesce(F.schema_of_variant("_any").startswith("OBJECT"), F.lit(False))
    # an object without attributes gives a row without key as well: it is told from other text by its kind
    items = parsed.select(F.when(is_item, F.col("_any")).alias("_item"))
    fields = items.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("_item").outer()))
    code = F.when(F.col("_item").isNull(), INVALID).when(F.col("key").isNotNull(), _variant_code(F.col("value")))
    bit = F.lit(0)
    for i, kind in enumerate(_KINDS):
        bit = F.when(F.col("_code") == kind, F.lit(1 << i)).otherwise(bit)
    merged = (
        fields.select("key", code.alias("_code"))
        .filter("_code is not null")
        .groupBy(F.col("key").alias("attribute"))
        .agg(
            F.bit_or(bit).alias("_bits"),
            F.count(F.lit(1)).alias("n_items"),
            F.count_if(F.col("_code") == NULL).alias("n_nulls"),
        )
    )
    names = F.array(*(F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) > 0, k) for i, k in enumerate(_KINDS)))
    shown = F.when(F.col("_bits") == 0, NULL).otherwise(F.array_join(names, "|"))
    return merged.select("attribute", shown.alias("type"), "n_items", "n_nulls")


def profile_tables(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, Sequence[str]] | None = None,
    order: Mapping[str, Sequence[str]] | None = None,
    sample: int | None = None,
) -> DataFrame:
    """:func:`table_profile` of every table, as one result."""
    found = [
        table_profile(df, name, (keys or {}).get(name, ()), (order or {}).get(name, ()), sample)
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, found)


def catalog_tables(spark: SparkSession, pattern: str = "*") -> dict[str, DataFrame]:
    """Tables and views of the session's catalog by name."""
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables(pattern=pattern)}
