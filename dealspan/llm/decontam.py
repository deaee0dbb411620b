"""Benchmark decontamination: short test items inside long documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealspan.llm.common import Scratch

SHINGLE = 5
CONTAINED = 0.8
#: A sketch table of at most so many rows is sent to every task; a larger one is joined by a shuffle.
SENT_ROWS = 200_000
NOT_WORDS = r"[^\p{L}\p{N}\p{M}]+"


def normal_words(text: Column) -> Column:
    """Words in lower case: runs of letters, marks and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORDS), "")


def _runs(words: Column, n: int, value) -> Column:
    """All runs of ``n`` words, each by ``value`` of its place from 0; none in fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), value))


def _by_length(words: Column, n: int, lengths: Sequence[int] | None, run: Callable[[int], Column], empty: str) -> Column:
    """The distinct shingles: runs of ``n`` words, and those of each of ``lengths``; without ``lengths``, those of an
    item, which is one shingle as a whole if it has fewer words."""
    none = F.array().cast(empty)
    if lengths is None:
        found = run(n)
        for m in range(1, n):
            found = F.when(F.size(words) == m, run(m)).otherwise(found)
        return F.array_distinct(F.coalesce(found, none))
    return F.array_distinct(F.concat(*(F.coalesce(run(m), none) for m in (n, *lengths))))


def shingle_hashes(df: DataFrame, n: int, lengths: Sequence[int] | None = ()) -> DataFrame:
    """``df`` with ``hashes``, the hashes of the shingles of its ``words``, in their place."""
    # the words' hashes are a column of their own, as a lambda would work out an expression for each of its calls
    each = df.withColumn("each", F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    run = lambda m: _runs(F.col("each"), m, lambda i: F.xxhash64(*(F.get(F.col("each"), i + j) for j in range(m))))
    # to be exploded as outer: a plain explode filters by size first, below this column, where it is worked out in the lambda
    return each.withColumn("hashes", _by_length(F.col("each"), n, lengths, run, "array<bigint>")).drop("each")


def shingles(words: Column, n: int, lengths: Sequence[int] | None = ()) -> Column:
    """The shingles themselves."""
    run = lambda m: _runs(words, m, lambda i: F.array_join(F.slice(words, i + 1, m), " "))
    return _by_length(words, n, lengths, run, "array<string>")


def item_sketches(items: DataFrame, n: int, contained: float) -> DataFrame:
    """Each item's smallest shingle hashes, as many as its size class needs: ``item_key``, ``hash``.

    Items are in classes by size, doubling from 1. If a document has at least ``contained`` of an item's s shingles, at
    most s - ceil(contained * s) are missing, so one more than that many of any of them has a hit. The sketch of a
    class has that number for its largest size, or all shingles of an item that has fewer. So no item is missed, and
    the sketch of the whole document is all its shingles that some item's sketch asks for.
    """
    own = shingle_hashes(items.select("item_key", "words"), n, None).filter(F.size("hashes") > 0)
    size = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes"))))
    wanted = (size - F.ceil(size * contained - 1e-9) + 1).cast("int")
    return own.select("item_key", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), wanted)).alias("hash"))


def _contained(docs: DataFrame, items: DataFrame, n: int, contained: float, id_col: str, text_col: str, item_col: str, item_text_col: str, sent_rows: int) -> DataFrame:
    """The pairs of ``contained_items`` with ``own_id``, ``text_key`` (a hash of the document's text) and ``own_item``."""
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")).filter(F.col("own_text").isNotNull())
    own = own.select("own_id", F.xxhash64("own_text").alias("text_key"), normal_words(F.col("own_text")).alias("words"))
    mine = items.select(F.col(item_col).alias("own_item"), normal_words(F.col(item_text_col)).alias("words")).distinct()
    with Scratch(docs.sparkSession) as scratch:
        mine = scratch.keep(mine.withColumn("item_key", F.monotonically_increasing_id()))
        sketch = scratch.keep(item_sketches(mine, n, contained))
        sent = F.broadcast if sketch.count() <= sent_rows else lambda df: df
        few = F.size("words")
        short = [r.m for r in mine.filter(few.between(1, n - 1)).select(few.alias("m")).distinct().collect()]  # under n values
        hashes = shingle_hashes(own, n, short).select("own_id", "text_key", F.explode_outer("hashes").alias("hash"))
        pairs = hashes.join(sent(sketch), "hash").select("own_id", "text_key", "item_key").distinct()
        pairs = scratch.keep(pairs)

        near = pairs.select("own_id", "text_key").distinct().withColumnRenamed("own_id", "near_id")
        same = own["own_id"].eqNullSafe(near["near_id"]) & (own["text_key"] == near["text_key"])
        texts = own.join(near, same, "left_semi").dropDuplicates(["own_id", "text_key"])
        has = texts.select("own_id", "text_key", F.explode_outer(shingles(F.col("words"), n, short)).alias("shingle"))
        asked = mine.select("item_key", F.explode_outer(shingles(F.col("words"), n, None)).alias("shingle")).filter("shingle is not null")
        sizes = asked.groupBy("item_key").agg(F.count("*").alias("n_item"))
        found = has.join(sent(asked.select("shingle").distinct()), "shingle", "left_semi")
        wanted = pairs.withColumnRenamed("own_id", "pair_id").withColumnRenamed("text_key", "pair_key")
        here = found["own_id"].eqNullSafe(wanted["pair_id"]) & (found["text_key"] == wanted["pair_key"])
        shared = found.join(wanted, here).join(asked, ["item_key", "shingle"])
        shared = shared.groupBy("own_id", "text_key", "item_key").agg(F.count("*").alias("n_shared")).join(sizes, "item_key")
        share = F.col("n_shared") / F.col("n_item")
        whole = shared.filter(F.col("n_shared") >= F.ceil(F.col("n_item") * contained - 1e-9)).join(mine.select("item_key", "own_item"), "item_key")
        return scratch.result(whole.select("own_id", "own_item", "n_shared", "n_item", share.alias("share"), "text_key").distinct())


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    n: int = SHINGLE,
    contained: float = CONTAINED,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    sent_rows: int = SENT_ROWS,
) -> DataFrame:
    """All pairs of a document and an item of whose distinct ``n``-word shingles it has ``contained`` at least.

    Candidates share a hash of the item's sketch (see ``item_sketches``); each is verified by its shingles themselves.
    The sketches go to every task if they have at most ``sent_rows`` rows, else the documents' hashes are dealt out to
    them. Words are runs of letters, marks and digits, in lower case.

    An item of fewer than ``n`` words has one shingle, all its words, and is looked for among the runs of that many words
    in all documents; this is done for the lengths that occur among the items.

    Returns the id column, the item column, ``n_shared``, ``n_item`` (distinct shingles) and ``share``. Texts without words, as null and
    empty ones, have no shingles: such documents hold no item, and such items are in no document. Very long texts are cut into
    shingles as a whole. Rows with equal id and text are one document or one item. Null ids are ids like any other. Other columns
    are not read. Empty tables give an empty result.
    """
    found = _contained(docs, items, n, contained, id_col, text_col, item_col, item_text_col, sent_rows)
    return found.select(F.col("own_id").alias(id_col), F.col("own_item").alias(item_col), "n_shared", "n_item", "share")


def without_items(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item, each row judged by its own text."""
    found = _contained(docs, items, n, contained, id_col, text_col, "item_id", "text", SENT_ROWS).select("own_id", "text_key").distinct()
    same = docs[id_col].eqNullSafe(found["own_id"]) & (F.xxhash64(docs[text_col]) == found["text_key"])
    return docs.join(found, same, "left_anti")
