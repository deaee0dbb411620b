"""Approximate nearest neighbours by a forest of sorted hash strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dealspan.llm.common import Scratch

TREES = 48
DIGITS = 4
#: Rotations have at most so many dimensions; a digit is below twice that.
WIDEST = 128
LEAST = 2000
SHARE = 0.25
#: Places of an array in a group, and rows of all arrays in a range of the sort.
BLOCK, RANGE_ROWS = 8192, 1_000_000
QUERY_CHUNK = 1024
SAMPLE = 20_000
#: Keys are measured in batches of two to this power.
BATCH_BITS = 13


def _rotations(width: int, trees: int, digits: int, seed: int) -> np.ndarray:
    """A random rotation, or projection on fewer dimensions, for each tree and digit."""
    draw = np.random.default_rng(seed)
    to = min(width, WIDEST)
    return np.stack([np.linalg.qr(draw.standard_normal((width, to)))[0] for _ in range(trees * digits)]).astype(np.float32).reshape(trees, digits, width, to)


def _bits(width: int) -> int:
    return (2 * min(width, WIDEST) - 1).bit_length()


def _hashed(shared):
    """Each vector's hash string in each tree: per digit, the axis of a rotation that it is nearest to."""
    names = ["tree", "hash", "key", "is_query"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, rotations = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors = np.array(part.column("vector").to_pylist(), np.float64).reshape(part.num_rows, -1)
                # the direction alone decides; sizes are brought into range first
                vectors -= mean
                vectors = (vectors / np.maximum(np.abs(vectors).max(axis=1, keepdims=True), 1e-300)).astype(np.float32)
                for tree, turns in enumerate(rotations):
                    hashes = np.zeros(part.num_rows, np.int64)
                    for turn in turns:
                        turned = vectors @ turn
                        axis = np.abs(turned).argmax(axis=1)
                        side = np.take_along_axis(turned, axis[:, None], axis=1)[:, 0] > 0
                        hashes = (hashes << _bits(len(mean))) | (2 * axis + side)
                    kind = pa.array(np.full(part.num_rows, tree, np.int32))
                    yield pa.RecordBatch.from_arrays([kind, pa.array(hashes), part.column("key"), part.column("is_query")], names=names)

    return run


def _bitmaps(keys: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The batches that keys are in, and a bitmap of the keys of each."""
    batches, at = np.unique(keys >> BATCH_BITS, return_inverse=True)
    bits = np.zeros((len(batches), 1 << BATCH_BITS), bool)
    bits[at, keys & ((1 << BATCH_BITS) - 1)] = True
    return batches, [row.tobytes() for row in np.packbits(bits, axis=1, bitorder="little")]


def _keys(batch: int, bitmap: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
    return (batch << BATCH_BITS) + np.flatnonzero(bits)


def _members(table: pa.Table) -> pa.Table:
    """A block of a tree's sorted array, with the ranges of places that are asked for: a bitmap for each batch of their keys."""
    rows = {n: table.column(n).to_numpy() for n in ("key", "place", "low", "high")}
    held = np.flatnonzero(rows["low"] < 0)
    held = held[np.argsort(rows["place"][held], kind="stable")]
    keys, places = rows["key"][held], rows["place"][held]
    tree = table.column("tree")[0].as_py() if table.num_rows else 0
    out: list[list] = [[], [], [], []]
    for i in np.flatnonzero(rows["low"] >= 0):
        low, high = rows["low"][i], rows["high"][i]
        batches, bitmaps = _bitmaps(keys[np.searchsorted(places, low) : np.searchsorted(places, high)])
        for x, y in zip(out, ([low] * len(batches), [high] * len(batches), batches, bitmaps), strict=True):
            x.extend(y)
    kinds = {"low": pa.int64(), "high": pa.int64(), "batch": pa.int64(), "keys": pa.binary()}
    columns = [pa.array(x, t) for x, t in zip(out, kinds.values(), strict=True)]
    return pa.table([pa.array([tree] * len(out[0]), pa.int32()), *columns], names=["tree", *kinds])


def _measure(k: int):
    """The ``k + 1`` nearest of each query's candidates in a block of vectors."""
    schema = pa.schema([("query", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = held.column("key").to_numpy()
        if not len(keys) or not asked.num_rows:
            return schema.empty_table()
        order = np.argsort(keys)
        keys, firsts = keys[order], held.column("first").combine_chunks().take(pa.array(order))
        firsts = np.unique(firsts.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # their order is all that counts
        vectors = np.array(held.column("vector").to_pylist(), np.float64)[order]
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(asked.num_rows):
            at = np.searchsorted(keys, _keys(asked.column("batch")[i].as_py(), asked.column("keys")[i].as_py()))
            gap = vectors[at] - np.array(asked.column("own")[i].as_py(), np.float64)
            score = np.sqrt((gap * gap).sum(axis=1))
            best = np.lexsort((firsts[at], score))[: k + 1]
            for x, y in zip(out, (np.full(len(best), asked.column("query")[i].as_py()), keys[at][best], score[best]), strict=True):
                x.append(y)
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    return run


def _numbered(written: DataFrame) -> DataFrame:
    """A written table's rows numbered from 0 without gaps as ``key``, by the number of rows of each writing task."""
    task = F.shiftright("at", 33)
    counts = written.groupBy(task.alias("task")).agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("task").collect()
    starts, before = [], 0
    for r in counts:  # one per task
        starts.append((r.task, before - r.first))
        before += r.n
    starts = written.sparkSession.createDataFrame(starts, "task long, shift long")
    return written.join(F.broadcast(starts), task == starts["task"]).withColumn("key", F.col("at") + F.col("shift")).drop("at", "task", "shift")


def nearest(
    vectors: DataFrame,
    queries: str,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    digits: int = DIGITS,
    least: int = LEAST,
    share: float = SHARE,
    sample: int = SAMPLE,
    seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest found, by Euclidean distance, to each row for which the SQL ``queries`` is true.

    Every tree is an array of all distinct vectors, sorted by a long string of digits: for each of ``digits`` random
    rotations, the axis and side that the vector is nearest to. A query goes down to its place in each array, where
    the rows with the longest common prefix stand on either side; then it goes up in all trees at once, a digit at a
    time, until the rows with at least so long a prefix are enough over all trees: ``share`` of all rows, counted once
    for each tree, and ``least`` at least. All rows with that prefix are measured exactly, on the original vectors in
    double precision, however many they are: in a cluster whose rows share their whole strings, that is the cluster.
    Only where the rows with one digit in common are too few, they are filled up by the nearest places of each array,
    ``least`` or four times a tree's part of ``share`` on either side.
    A global sort deals the arrays into blocks of one size, whatever the size of the table; the rows of a prefix are
    taken block by block, once for all its queries.
    The rotations are about the mean of at most ``sample`` vectors; all rows are in the index.

    Vectors without any structure, as random ones, need a share like the default for a recall over 0.9, as their
    neighbours are hardly nearer than the rest; the work then grows with queries times rows. Where neighbours are
    close, far smaller shares do, down to ``least`` alone.

    Equal vectors are one entry, with the smallest ``k + 1`` of their ids, as no more can be among the nearest;
    so the copies of a vector are never gathered. Returns ``query_id``, ``rank`` (from 1; equal distances by the
    smaller id), the id column and ``score``, the distance. A query is no candidate of its own. Rows whose id or
    vector is null, whose vector is empty, zero, of another length than most, or holds null, infinite or NaN take
    no part; where several rows have the same id and vector, one counts. Other columns are not read. With up to
    ``least`` vectors all are measured. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col("vector")
    own = vectors.select(F.col(id_col).alias("own_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.expr(queries).alias("asks"))
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    own = own.filter(F.col("own_id").isNotNull() & sound)
    schema = T.StructType([
        T.StructField("query_id", own.schema["own_id"].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField(id_col, own.schema["own_id"].dataType), T.StructField("score", T.DoubleType()),
    ])
    with Scratch(spark) as scratch:
        own = scratch.keep(own)
        sizes = own.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if sizes is None:
            return spark.createDataFrame([], schema)
        width = sizes.n
        own = own.filter(F.size("vector") == width).groupBy("own_id", "vector").agg(F.bool_or(F.coalesce("asks", F.lit(False))).alias("asks"))
        ranked = own.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("own_id"))).filter(F.col("nth") <= k + 1)
        ids = ranked.groupBy("vector").agg(F.sort_array(F.collect_list("own_id")).alias("ids"))
        asked = own.filter("asks").groupBy("vector").agg(F.lit(True).alias("is_query"))
        entries = ids.join(asked, "vector", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
        entries = _numbered(scratch.keep(entries.withColumn("at", F.monotonically_increasing_id())))

        some = entries.select("vector").orderBy(F.xxhash64("vector"), "key").limit(sample)
        mean = some.select(F.posexplode("vector").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("x")).orderBy("at").collect()
        shared = spark.sparkContext.broadcast((np.array([r.x for r in mean]), _rotations(width, trees, digits, seed)))
        index = entries.select("vector", "key", "is_query").mapInArrow(_hashed(shared), "tree int, hash long, key long, is_query boolean")
        count = entries.count()
        enough = max(least, int(share * count))
        reach = max(least, 4 * enough // trees)
        bits = _bits(width)
        n = max(1, -(-count * trees // RANGE_ROWS))
        index = index.repartitionByRange(n, "tree", "hash", "key").sortWithinPartitions("tree", "hash", "key")
        index = scratch.keep(index.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))
        parts = index.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("tree", "part").collect()
        before: dict[int, int] = {}
        starts = []
        for r in parts:  # a row per range and tree in it
            starts.append((r.tree, r.part, r.first, before.get(r.tree, 0)))
            before[r.tree] = before.get(r.tree, 0) + r.n
        starts = spark.createDataFrame(starts, "tree int, part int, first long, before long")
        index = index.join(F.broadcast(starts), ["tree", "part"])
        index = index.select("tree", "hash", "key", "is_query", (F.col("at") - F.col("first") + F.col("before")).alias("place"))
        index = scratch.keep(index)
        cuts = F.posexplode(F.array(*(F.shiftright("hash", bits * (digits - d)) for d in range(1, digits + 1)))).alias("depth", "prefix")
        runs = index.select("tree", "place", cuts).groupBy("tree", "depth", "prefix").agg(F.min("place").alias("low"), F.count("*").alias("n"))
        own_runs = index.filter("is_query").select("tree", "key", "place", cuts).join(runs, ["tree", "depth", "prefix"])
        own_runs = scratch.keep(own_runs.select("tree", "key", "place", F.col("depth") + 1, "low", (F.col("low") + F.col("n")).alias("high")).toDF("tree", "key", "place", "depth", "low", "high"))
        sums = own_runs.groupBy("key", "depth").agg(F.sum(F.col("high") - F.col("low") - 1).alias("n"))  # a row for each number of digits
        stop = sums.groupBy("key").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("depth"))), F.lit(0)).alias("stop"))
        taken = own_runs.join(stop, "key").filter(F.col("depth") == F.greatest("stop", F.lit(1)))
        few = F.col("stop") == 0
        low = F.when(few, F.greatest(F.least("low", F.col("place") - reach), F.lit(0))).otherwise(F.col("low"))
        high = F.when(few, F.greatest("high", F.col("place") + (reach + 1))).otherwise(F.col("high"))
        taken = scratch.keep(taken.select("tree", F.col("key").alias("query"), low.alias("low"), high.alias("high")))
        none = F.lit(-1).cast("long")
        held = index.select("tree", F.floor(F.col("place") / BLOCK).alias("block"), "key", "place", none.alias("low"), none.alias("high"))
        blocks = F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.least("high", F.lit(count)) - 1) / BLOCK))).alias("block")
        wanted = taken.select("tree", "low", "high").distinct().select("tree", blocks, none.alias("key"), none.alias("place"), "low", "high")
        members = held.union(wanted).groupBy("tree", "block").applyInArrow(_members, "tree int, low long, high long, batch long, keys binary")
        found = taken.join(members, ["tree", "low", "high"]).select("query", "batch", "keys")
        batch = F.shiftright("key", BATCH_BITS).alias("batch")
        bit = F.bitmap_construct_agg(F.col("key").bitwiseAND(F.lit((1 << BATCH_BITS) - 1)))
        itself = entries.filter("is_query").groupBy(F.col("key").alias("query"), batch).agg(bit.alias("keys"))  # for copies of the query

        asking = entries.filter("is_query").select(F.col("key").alias("query"), F.col("vector").alias("own"))
        chunks = max(1, -(-asking.count() // QUERY_CHUNK))
        chunk = F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("long").alias("chunk")
        pairs = found.union(itself).groupBy("batch", "query").agg(F.bitmap_or_agg("keys").alias("keys"))
        pairs = pairs.join(asking, "query").select("batch", chunk, "query", "own", "keys")
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk")
        stored = entries.select(batch, "key", "vector", F.col("ids")[0].alias("first"), each)
        by = ["batch", "chunk"]
        scores = pairs.groupBy(*by).cogroup(stored.groupBy(*by)).applyInArrow(_measure(k), "query long, key long, score double")
        measured = scores.join(entries.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias(id_col))
        asks = own.filter("asks").join(asking, own["vector"] == asking["own"]).select("query", F.col("own_id").alias("query_id"))
        best = measured.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("score", id_col))).filter(F.col("nth") <= k + 1)
        best = best.select("query", id_col, "score").join(asks, "query").filter(F.col("query_id") != F.col(id_col))
        order = Window.partitionBy("query_id").orderBy("score", id_col)
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return scratch.result(best.select("query_id", "rank", id_col, "score"))
