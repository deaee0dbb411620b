"""Round trips: cleaning, upsert, repeated loads, row numbers, CSV and profiles."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.schema import DEALS, DISPLAY_NAMES, raw_listings_schema
from dealspan.sources import ingest, profile, readers, sinks, versions


@pytest.fixture
def raw(spark):
    schema = T.StructType(
        [T.StructField(DISPLAY_NAMES[c], T.StringType()) for c in
         ("listing_id", "sold_date", "list_price", "sold_price", "total_flr_area_sf", "year_built",
          "listing_firm", "buyer_firm")]
    )
    return spark.createDataFrame(
        [
            ("1", "1/5/2024", "$1,200.50", "$1,100.25", "1,234", "1999.0", "Re/Max", "N/A"),
            ("2", "12/31/2024", None, "N/A", "", None, "nan", " "),
        ],
        schema,
    )


def test_clean_deals(raw):
    first, second = ingest.clean_deals(raw).orderBy("listing_id").collect()
    assert first.sold_date == date(2024, 1, 5)
    assert (first.list_price, first.sold_price) == (Decimal("1200.50"), Decimal("1100.2500"))
    assert (first.total_flr_area_sf, first.year_built) == (1234.0, 1999)
    assert (first.listing_firm, first.buyer_firm) == ("Re/Max", None)
    assert [second[c] for c in ("list_price", "sold_price", "total_flr_area_sf", "listing_firm", "buyer_firm")] == [None] * 5


def test_clean_deals_strict_or_not(spark, raw):
    bad = raw.withColumn("Sold Price", F.lit("$oops"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ingest.clean_deals(bad).collect()
    assert [r.sold_price for r in ingest.clean_deals(bad, strict=False).collect()] == [None, None]


def test_export_and_clean_are_inverse(spark):
    row = {f.name: None for f in DEALS}
    row.update(
        listing_id="7", sold_date=date(2024, 2, 29), list_price=Decimal("1234567.80"),
        sold_price=Decimal("0.1250"), total_flr_area_sf=4321.5, total_bedrooms=3, listing_firm="F",
        sold_list_ratio=97.25,
    )
    deals = spark.createDataFrame([tuple(row[f.name] for f in DEALS)], DEALS)
    assert ingest.clean_deals(ingest.export_text(deals)).collect() == deals.collect()


def test_listing_items(spark, raw):
    full = readers.with_columns_present(readers.to_canonical_names(raw), DEALS)
    items = ingest.listing_items(full)
    assert items.columns == ingest.item_columns() and len(items.columns) == 19
    second = items.filter("`listing_id_#` = '2'").first()
    assert (second.list_price, second.sold_price, second.address) == (0, 0, "N/A")


def test_brokerage_items(spark):
    raw = spark.createDataFrame(
        [("a", 1.5), (None, 2.0), ("nan", 3.0), ("b", float("inf"))], "broker string, value double"
    )
    got = {r.broker: r.value for r in ingest.brokerage_items(raw).collect()}
    assert got == {"a": Decimal("1.5"), "b": None}
    with pytest.raises(ValueError, match="no column 'broker'"):
        ingest.brokerage_items(raw.drop("broker"))


def test_clean_brokerage(spark):
    raw = spark.createDataFrame([("A", "1/1/2024", "5"), (None, "x", "y")], "Broker string, Date string, Value string")
    assert [tuple(r) for r in ingest.clean_brokerage(raw).collect()] == [("A", date(2024, 1, 1), 5.0)]


def test_raw_schema_reads_an_export(spark, tmp_path):
    path = str(tmp_path / "listings")
    headers = list(DISPLAY_NAMES.values())
    row = spark.createDataFrame([tuple("N/A" for _ in headers)], raw_listings_schema())
    sinks.export_csv(row, path)
    cleaned = ingest.clean_deals(readers.read_csv(spark, path, raw_listings_schema()))
    assert cleaned.schema == DEALS
    assert list(cleaned.first()) == [None] * len(headers)


def test_written_files_are_sorted_by_date(spark, tmp_path):
    path = str(tmp_path / "deals")
    rows = [(str(i), date(2020 + i % 3, 1 + i % 12, 1 + i * 7 % 28)) for i in range(500)]
    sinks.write_deals(spark.createDataFrame(rows, "listing_id string, sold_date date"), path)
    stored = spark.read.parquet(path).select("sold_date", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    by_file = {}
    for r in stored.orderBy("at").collect():
        by_file.setdefault(r.file, []).append(r.sold_date)
    assert all(days == sorted(days) for days in by_file.values())


def test_shared_dir_is_the_configured_one(spark):
    from dealspan.session import shared_dir

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert named is None or shared_dir(spark) == named


def test_upsert_twice_is_once(spark, tmp_path):
    load = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "c")], "key string, seq int, v string")
    latest = [F.desc("seq")]
    once, twice = str(tmp_path / "one"), str(tmp_path / "two")
    sinks.write_upsert(spark, None, load, ["key"], latest, once)
    sinks.write_upsert(spark, once, load, ["key"], latest, twice)
    rows = sorted(tuple(r) for r in spark.read.parquet(twice).collect())
    assert rows == [("k", 2, "b"), ("m", 1, "c")] == sorted(tuple(r) for r in spark.read.parquet(once).collect())
    with pytest.raises(ValueError):
        sinks.write_upsert(spark, once, load, ["key"], latest, once)


def test_repeated_load_replaces_only_itself(spark, tmp_path):
    path, lost = str(tmp_path / "t"), str(tmp_path / "rejects")
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    for load in ("x", "y", "y"):
        sinks.write_load(df, path, load, F.col("v") > 0, lost)
    counts = {r.load_id: r["count"] for r in spark.read.parquet(path).groupBy("load_id").count().collect()}
    assert counts == {"x": 2, "y": 2}
    assert spark.read.parquet(lost).count() == 2


def test_a_load_is_seen_whole(spark, tmp_path):
    path = str(tmp_path / "loads")
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    for load in ("x", "y/1", "y/1"):
        versions.commit_load(df, path, load, F.col("v") > 0)
    rows = lambda rejected: sorted((r.load_id, r.v) for r in versions.read_loads(spark, path, rejected).collect())
    both = rows(False), rows(True)
    assert both == ([("x", 1), ("x", 2), ("y/1", 1), ("y/1", 2)], [("x", None), ("y/1", None)])
    bad = df.withColumn("v", F.when(F.col("v") == 2, F.raise_error("broken")).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="broken"):
        versions.commit_load(bad, path, "x", F.col("v") > 0)
    assert (rows(False), rows(True)) == both  # what was written before the failure is not seen
    before = versions.read_loads(spark, path)
    versions.commit_load(df.limit(0), path, "x")
    assert rows(False) == [("y/1", 1), ("y/1", 2)] and rows(True) == [("y/1", None)]
    assert before.count() == 4  # a reader that began before still has its rows
    with pytest.raises(ValueError):
        versions.commit_load(df.withColumn("rejected", F.lit(1)), path, "z")
    with pytest.raises(ValueError):
        versions.read_loads(spark, str(tmp_path / "nothing"))


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    versions._mark(spark, path, "k", 1, {"v": 1})
    with pytest.raises(RuntimeError):
        versions._mark(spark, path, "k", 1, {"v": 2})
    assert versions._valid(spark, path, "k") == (1, {"v": 1})


def test_upsert_leaves_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    load = lambda ids, v: spark.createDataFrame([(f"k{i:03d}", v, i) for i in ids], "key string, v string, seq int")
    versions.upsert(load(range(200), "old").repartitionByRange(5, "key"), path, ["key"], [F.desc("seq")])
    first = set(versions.table_files(spark, path))
    versions.upsert(load([3, 3, 500], "new"), path, ["key"], [F.desc("seq")])
    second = set(versions.table_files(spark, path))
    assert len(first - second) == 1 and len(first) > 1
    got = {r.key: r.v for r in versions.read_upserted(spark, path).collect()}
    assert got == {**{f"k{i:03d}": "old" for i in range(200)}, "k003": "new", "k500": "new"}
    assert versions.read_upserted(spark, path).count() == 201
    versions.upsert(load([], "x"), path, ["key"], [F.desc("seq")])
    assert versions.read_upserted(spark, path).count() == 201


def test_file_row_numbers_move_no_rows(spark, tmp_path):
    path = str(tmp_path / "sorted")
    spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("file"), F.lit("y").alias("at")).repartitionByRange(7, "v").sortWithinPartitions("v").write.parquet(path)
    numbered = sinks.with_file_row_number(spark, path)
    assert numbered.columns == ["v", "file", "at", "row_index"]
    assert all(r.v == r.row_index and (r.file, r["at"]) == ("x", "y") for r in numbered.collect()) and numbered.count() == 1000
    plan = numbered._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Exchange" not in plan


def test_cached_tables_are_released(spark):
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    with sinks.cached(spark.range(10)) as table:
        assert table.count() == 10 and held() == before + 1
    assert held() == before


def test_counts_keep_their_fractions(spark):
    schema = T.StructType([T.StructField(DISPLAY_NAMES[c], T.StringType()) for c in ("listing_id", "total_baths", "total_bedrooms")])
    frame = lambda *r: spark.createDataFrame([r], schema)
    assert tuple(ingest.clean_deals(frame("1", "2.5", "3.0")).first()) == ("1", 3, 2.5)
    for bad in ("2.5", "many"):
        with pytest.raises(Exception, match="whole number|CAST_INVALID_INPUT"):
            ingest.clean_deals(frame("1", "1", bad)).collect()
        assert ingest.clean_deals(frame("1", "1", bad), strict=False).first().total_bedrooms is None


def test_items_of_a_narrow_export(spark):
    items = ingest.listing_items(spark.createDataFrame([("7", "$5")], "`Listing ID #` string, `Sold Price` string"))
    assert items.columns == ingest.item_columns()
    row = items.first()
    assert (row.sold_price, row.list_price, row.community, row.sold_date) == (5, 0, "N/A", "N/A")


def test_row_numbers_and_batches(spark):
    df = spark.range(0, 1234, 1, 7).select((F.col("id") * 7919 % 1234).alias("v"), F.lit(1).alias("hot"))
    rows = sinks.with_row_number(df, ["hot", "v"]).collect()
    assert all(r.row_index == r.v for r in rows) and len(rows) == 1234
    sizes = sinks.with_batches(df, ["v"], 500).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [tuple(r) for r in sizes] == [(1, 500), (2, 500), (3, 234)]


def test_row_ids_are_unique(spark):
    ids = sinks.with_row_id(spark.range(0, 100, 1, 5))
    assert ids.select("row_id").distinct().count() == 100


def test_written_deals_prune_years(spark, tmp_path):
    path = str(tmp_path / "deals")
    rows = [(str(i), date(2020 + i % 4, 1 + i % 12, 1)) for i in range(200)]
    deals = spark.createDataFrame(rows, "listing_id string, sold_date date")
    sinks.write_deals(deals, path)
    found = readers.scan_table(spark, path, date(2021, 1, 1), date(2021, 12, 31))
    assert found.count() == 50
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sold_year" in plan and "GreaterThanOrEqual(sold_date" in plan


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame([("a, \"quoted\"", 1), (None, 2)], "t string, n int")
    sinks.export_csv(df, path, single_file=True)
    got = readers.read_csv(spark, path, df.schema).orderBy("n").collect()
    assert [tuple(r) for r in got] == [('a, "quoted"', 1), (None, 2)]


def test_documents_and_aliases(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([("id1", 5)], "_id string, v int").write.json(path)
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("v", T.IntegerType())])
    assert readers.scan_documents(spark, path, schema).columns == ["v"]
    assert readers.physical_name("listings") == "deals"
    assert readers.physical_name("anything") == "anything"


def test_names_round_trip(spark):
    df = spark.createDataFrame([(1, 2)], "sold_price int, other int")
    shown = readers.to_display_names(df)
    assert shown.columns == ["Sold Price", "other"]
    assert readers.to_canonical_names(shown).columns == df.columns


def test_load_tables_and_preview(spark):
    full, empty = spark.range(10), spark.range(0)
    assert list(readers.load_tables({"full": full, "empty": empty})) == ["full"]
    assert [r.id for r in readers.preview(full, 2, ["id"]).collect()] == [0, 1]


def test_table_profile(spark):
    df = spark.createDataFrame(
        [(1, "a", None, [1], {"k": 1}, True), (2, None, None, None, None, None)],
        "id int, t string, never double, l array<int>, m map<string,int>, b boolean",
    )
    got = {(r.attribute, r.type, r.is_key) for r in profile.table_profile(df, "x", ["id"], ["id"]).collect()}
    assert got == {("id", "N", True), ("t", "S", False), ("l", "L", False), ("m", "M", False), ("b", "BOOL", False)}
    assert [r.attribute for r in profile.table_profile(df.limit(0), "x", ["id"]).collect()] == ["id"]


def test_item_profile_merges_types(spark):
    rows = [(1, '{"a": 1, "b": "x", "c": null}'), (2, '{"a": "text", "d": [1], "e": {"z": 1}, "f": true}'), (3, "{}"),
            (4, '{"a": null, "b": '), (5, "[1]"), (6, "7"), (7, None), (8, '{"a": 2.5}'), (9, "")]
    df = spark.createDataFrame(rows, "id int, props string")
    got = {r.attribute: (r.type, r.n_items, r.n_nulls) for r in profile.item_profile(df, "props", ["id"]).collect()}
    assert got == {"a": ("N|S", 3, 0), "b": ("S", 1, 0), "c": ("NULL", 1, 1), "d": ("L", 1, 0), "e": ("M", 1, 0),
                   "f": ("BOOL", 1, 0), None: ("INVALID", 4, 0)}
    first = {r.attribute: r.type for r in profile.item_profile(df, "props", ["id"], sample=1).collect()}
    assert first == {"a": "N", "b": "S", "c": "NULL"}
    assert profile.item_profile(df.limit(0), "props").count() == 0


def test_profiles_read_all_rows(spark):
    df = spark.range(0, 50_000, 1, 8).select(
        "id", F.when(F.col("id") == 49_999, 1).alias("late"), F.lit(None).cast("string").alias("never"),
        F.when(F.col("id") == 49_998, '{"late": 1}').otherwise('{"early": 1}').alias("item"),
    )
    got = {r.attribute: (r.is_key, r.n_values) for r in profile.table_profile(df, "x", ["id"]).collect()}
    assert got == {"id": (True, 50_000), "late": (False, 1), "item": (False, 50_000)}
    items = profile.item_profile(df, "item")
    assert {(r.attribute, r.n_items) for r in items.collect()} == {("late", 1), ("early", 49_999)}
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "Limit" not in plan
