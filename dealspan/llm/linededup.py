"""Removal of repeated passages of lines by overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealspan.llm.common import Scratch, free_names

WIDTH = 3


def repeated_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines of each text that later occurrences of repeated windows cover: ``removed``, ranges in order.

    A window is ``width`` consecutive lines that are not all blank. Windows that are equal in all lines are
    occurrences of each other; the first is the one with the smallest id (null last), then the smallest place. All
    others cover their lines, but in the first one's own document only those after it. Returns ``own_id``, ``text_key``
    (a hash of the text) and ``removed``, structs of ``begin`` (from 0) and ``stop`` (not included) that do not
    overlap, for texts with such lines.
    """
    lines = F.split(F.col("own_text"), "\n", -1)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text")).filter(F.col("own_text").isNotNull())
    own = own.select("own_id", F.xxhash64("own_text").alias("text_key"), lines.alias("lines")).filter(F.size("lines") >= width)
    # two hashes of each line, so that a window's key has 128 bits
    lows, highs = F.transform("lines", lambda x: F.xxhash64(x)), F.transform("lines", lambda x: F.xxhash64(x, F.lit(1)))
    blank = F.transform("lines", lambda x: F.trim(F.translate(x, "\t\r ", "   ")) == "")
    own = own.select("own_id", "text_key", lows.alias("low"), highs.alias("high"), blank.alias("blank"))
    parts = lambda c, i: [F.get(F.col(c), i + j) for j in range(width)]
    window = lambda i: F.struct(
        F.xxhash64(*parts("low", i)).alias("low"),
        F.xxhash64(*parts("high", i)).alias("high"),
        F.forall(F.slice("blank", i + 1, width), lambda b: b).alias("blank"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("low") - width), window)
    # as outer: a plain explode filters by size first, below these columns, where lambdas work them out for each call
    own = own.select("own_id", "text_key", F.posexplode_outer(windows).alias("place", "w")).filter("not w.blank")
    own = own.select("own_id", "text_key", "place", "w.low", "w.high")
    place = F.struct(F.col("own_id").isNull().alias("late"), "own_id", "text_key", "place")
    first = own.groupBy("low", "high").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n")
    later = own.join(first, ["low", "high"])
    same = F.col("first.own_id").eqNullSafe(F.col("own_id")) & (F.col("first.text_key") == F.col("text_key"))
    begin = F.when(same, F.greatest("place", F.col("first.place") + width)).otherwise(F.col("place"))
    covered = later.filter(~(same & (F.col("place") == F.col("first.place"))))
    covered = covered.select("own_id", "text_key", begin.alias("begin"), (F.col("place") + width).alias("stop"))
    covered = covered.filter("begin < stop").distinct()
    # a range begins where no earlier window reaches to
    text = Window.partitionBy("own_id", "text_key")
    before = F.max("stop").over(text.orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1))
    fresh = covered.withColumn("fresh", F.coalesce((F.col("begin") > before).cast("int"), F.lit(1)))
    each = fresh.withColumn("range", F.sum("fresh").over(text.orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, 0)))
    merged = each.groupBy("own_id", "text_key", "range").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop"))
    ranges = F.sort_array(F.collect_list(F.struct("begin", "stop")))  # of one text
    return merged.groupBy("own_id", "text_key").agg(ranges.alias("removed"))


def _joined(docs: DataFrame, width: int, id_col: str, text_col: str) -> tuple[DataFrame, Column, Column, Column]:
    """``docs`` with all columns as they are, and expressions on it: the text without removed lines, lines, lines removed."""
    key, own, removed, lines = free_names(docs, "text_key", "own_id", "removed", "lines")
    found = repeated_lines(docs, width, id_col, text_col).toDF(own, key, removed)
    same = docs[id_col].eqNullSafe(found[own]) & (F.xxhash64(docs[text_col]) == found[key])
    # the lines are a column of their own, as a lambda would split the text again for each of its calls
    joined = docs.join(found, same, "left").withColumn(lines, F.split(docs[text_col], "\n", -1))
    ranges, parts = F.col(removed), F.col(lines)

    def between(i: Column) -> Column:
        """The lines after range i - 1 and before range i."""
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(ranges, i - 1)["stop"])
        stop = F.when(i == F.size(ranges), F.size(parts)).otherwise(F.get(ranges, i)["begin"])
        return F.slice(parts, begin + 1, stop - begin)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(ranges)), between))
    text = F.when(ranges.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts))
    n_removed = F.aggregate(F.coalesce(ranges, F.array().cast("array<struct<begin:int,stop:int>>")), F.lit(0), lambda n, r: n + r["stop"] - r["begin"])
    return joined, text, n_lines, n_removed


def dedup_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines removed that ``repeated_lines`` finds, and ``n_lines`` and ``n_removed``.

    Lines end at line feeds only; the lines kept are joined by them again. A text with fewer lines than ``width`` is not
    changed; an empty one has one line; a null one stays null and has none. Rows that are equal in id and text, null ids
    included, are one document: both come out alike. All other columns are kept, but for any named ``n_lines`` or ``n_removed``. A text's
    lines are cut out by ranges, so the work grows with its length also for very long texts. An empty table gives an empty result.
    """
    joined, text, n_lines, n_removed = _joined(docs.drop("n_lines", "n_removed"), width, id_col, text_col)
    new = {text_col: text}
    out = [new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*out, n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def without_repeated_lines(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with repeated lines removed and no other column changed, but for ``n_chars``, the length of the text, if there is one."""
    joined, text, _, _ = _joined(docs, width, id_col, text_col)
    new = {text_col: text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns)))
