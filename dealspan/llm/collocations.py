"""Phrases that stand out, counted by FM-indexes over the word numbers of shards."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dealspan.llm.arrays import ranges, runs
from dealspan.llm.common import Scratch, slices

LONGEST = 3
LEAST = 10
TOP = 2000
#: Containment, in percent, from which a phrase goes with the longer one.
COVERED = 50
SHARD_WORDS = 3_000_000
#: Between pieces, and the number it has in every shard; no byte of UTF-8 is 255.
_STOP, STOP = b"\xff", 0
_BYTES = bytes(255 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
INDEX = "own_lang string, words array<string>, counts array<long>, body binary"


def _packed(symbols: np.ndarray) -> bytes:
    """Compressed, all low bytes first: there most of the difference is."""
    return zstandard.ZstdCompressor(level=3).compress(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _numbers() -> defaultdict[bytes, int]:
    """Numbers words as they come, from 1; 0 stands between pieces."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[_STOP]
    return numbers


class _Shard:
    """The words of some texts in one language, as numbers."""

    def __init__(self) -> None:
        self.numbers = _numbers()
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, words: list[bytes]) -> None:
        words.append(_STOP)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        self.n += len(words)

    def row(self, lang: str) -> dict:
        symbols = np.concatenate(self.parts)
        counts = np.bincount(symbols, minlength=len(self.numbers))
        by = np.r_[0, 1 + np.argsort(-counts[1:], kind="stable")]  # frequent words get small numbers
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        words = list(self.numbers)
        return {"own_lang": lang, "words": [words[i].decode() for i in by[1:]], "counts": counts[by[1:]], "body": _packed(number[symbols])}


def _shards(most: int) -> Callable:
    """Cuts a task's texts into shards of one language and about ``most`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Shard] = {}

        def finish(lang: str) -> pa.RecordBatch:
            row = held.pop(lang).row(lang)
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

        total = 0
        for batch in batches:
            for part, texts in slices(batch, "own_text"):
                for lang, text in zip(part.column("own_lang").to_pylist(), texts, strict=True):
                    # also blanks to bytes.split are only the two of the words' pattern: the others are stops by now
                    words = text.encode().translate(_BYTES).replace(_STOP, b" " + _STOP + b" ").split() if text else []
                    if not words:
                        continue
                    shard = held.setdefault(lang, _Shard())
                    shard.add(words)
                    total += len(words)
                    if shard.n >= most or total >= 2 * most:
                        total -= (big := max(held.values(), key=lambda s: s.n)).n
                        yield finish(next(k for k, s in held.items() if s is big))
        for lang in list(held):
            yield finish(lang)

    return run


def _sorted(symbols: np.ndarray, depth: int) -> np.ndarray:
    """All places (cyclic) in the order of the ``depth`` symbols that begin there."""
    bits = max(1, int(symbols.max()).bit_length())
    key, width = symbols.copy(), bits
    for j in range(1, depth):
        if width + bits > 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            width = len(key).bit_length()
        key = (key << bits) | np.roll(symbols, -j)
        width += bits
    return np.argsort(key, kind="stable")


class Side:
    """The symbols before the sorted places (BWT, sorted to a limited depth), and where each of them is sorted itself."""

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.last = symbols[_sorted(symbols, depth) - 1]
        by = np.argsort(self.last, kind="stable")
        self.map = np.empty_like(by)
        self.map[by] = np.arange(len(by))


class Index:
    """A bidirectional FM-index for n-grams of up to ``depth`` symbols.

    An n-gram is an interval ``lo`` among the sorted places, ``back`` among those of the reversed text, both of length ``n``, its
    count. Sorting by ``depth`` symbols is enough: an interval of fewer is contiguous, and so is what it maps to.
    """

    def __init__(self, symbols: np.ndarray, depth: int) -> None:
        self.forward = Side(symbols, depth)
        self.backward = Side(symbols[::-1].copy(), depth)
        self.count = np.bincount(symbols)
        self.first = np.cumsum(self.count) - self.count

    def one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.first[symbols], self.first[symbols], self.count[symbols]

    def left(self, lo: np.ndarray, back: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by a symbol before: the n-gram extended, the symbol, and ``lo``, ``back``, ``n``."""
        return _extended(self.forward, lo, back, n)

    def right(self, lo: np.ndarray, back: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by a symbol behind, like ``left``."""
        of, symbol, back, lo, n = _extended(self.backward, back, lo, n)
        return of, symbol, lo, back, n


def _extended(side: Side, own: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    at = ranges(own, n)
    of, symbol = np.repeat(np.arange(len(n)), n), side.last[at]
    key = of * (int(symbol.max(initial=0)) + 1) + symbol
    by = np.argsort(key, kind="stable")
    new = runs(key[by])
    of, symbol = of[by][new], symbol[by][new]
    before = new - (np.cumsum(n) - n)[of]  # places of the interval with smaller symbols
    return of, symbol, side.map[at[by][new]], other[of] + before, np.diff(np.r_[new, len(by)])


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(0).to_numpy().astype(np.int64, copy=False)


class _Known:
    """The frequent words of a shard, and its frequent pairs of words."""

    def __init__(self, found: pa.Table, n_symbols: int) -> None:
        level, a, b = (_column(found, c) for c in ("level", "a", "b"))
        self.of = np.full(n_symbols, -1, np.int64)  # a word's id in the corpus by its number here
        self.of[a[level == 1]] = b[level == 1]
        self.numbers = np.flatnonzero(self.of >= 0)
        by = np.argsort(self.of[self.numbers])
        ids = self.of[self.numbers][by]
        local = lambda x: self.numbers[by[np.searchsorted(ids, x)]]
        self.n = n_symbols
        self.pairs = np.sort(local(a[level == 2]) * n_symbols + local(b[level == 2])) if (level == 2).any() else np.empty(0, np.int64)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        if not len(self.pairs):
            return np.zeros(len(key), bool)
        return self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key


def _grams(size: int) -> Callable:
    """The shard's pairs of frequent words (``size`` 2) or triples of frequent pairs (3), with their counts."""
    names = ["shard", *"abc"[:size], "n"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(index: pa.Table, found: pa.Table) -> pa.Table:
        if not index.num_rows or not found.num_rows:
            return schema.empty_table()
        symbols = _unpacked(index.column("body")[0].as_py())
        known = _Known(found, int(symbols.max()) + 1)
        fm = Index(symbols, size) if size == 3 else None
        if fm is None:
            side, count = Side(symbols, size), np.bincount(symbols)
            first = (np.cumsum(count) - count)[known.numbers]
            of, word, _, _, n = _extended(side, first, first, count[known.numbers])
            keep = known.of[word] >= 0
            columns = [known.of[word[keep]], known.of[known.numbers[of[keep]]], n[keep]]
        else:
            of, a, lo, back, n = fm.left(*fm.one(known.numbers))
            b = known.numbers[of]
            keep = known.has(a, b)
            a, b = a[keep], b[keep]
            of, c, _, _, n = fm.right(lo[keep], back[keep], n[keep])
            keep = known.has(b[of], c)
            columns = [known.of[a[of[keep]]], known.of[b[of[keep]]], known.of[c[keep]], n[keep]]
        shard = np.full(len(columns[0]), index.column("shard")[0].as_py(), np.int64)
        return pa.table([pa.array(x, pa.int64()) for x in (shard, *columns)], schema=schema)

    return run


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
    lang_col: str = "lang",
    text_col: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The best ``top`` phrases of two to ``longest`` (2 or 3) words in each language, by their weakest cut.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words. A phrase
    counts wherever its words follow one another in a piece (``a``, at least ``least``). A cut into two parts that occur ``l`` and
    ``r`` times scores floor(1000000*a*a/(l*r)); a phrase's lowest cut counts, the shortest first part of equals. A phrase inside a longer
    candidate that occurs at least ``covered`` percent as often is left out, whether that one stays or not. Returns ``lang``, ``rank``
    (by score, a, then bytes of the phrase), ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of the language) and ``score``.

    1. Each task numbers the words of its texts in shards of one language with about ``shard_words`` words, or one longer text.
    2. Words are summed over the shards; those under ``least`` are in no candidate. Each shard's FM-index extends its frequent words
       to the left; the pairs are summed.
    3. Each shard extends its frequent pairs to the right, where the last two words are a frequent pair too; the triples are summed.

    All counts are over all texts and exact. No text moves; a shard sends each of its n-grams once, so that a frequent one
    has as many rows as there are shards. Null texts are empty, texts without words count for nothing, a null language is ``und``, and equal rows
    are texts of their own. Other columns are not read. An empty table has no phrases.
    """
    if longest not in (2, 3):
        raise ValueError("phrases of 2, or of 2 and 3 words")
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("own_lang"), F.col(text_col).alias("own_text"))
    with Scratch(docs.sparkSession) as scratch:
        index = scratch.keep(own.mapInArrow(_shards(shard_words), INDEX).withColumn("shard", F.monotonically_increasing_id()))
        each = index.select("shard", "own_lang", F.posexplode_outer(F.arrays_zip("words", "counts")).alias("pos", "x"))
        each = each.filter("x is not null").select("shard", "own_lang", (F.col("pos") + 1).cast("long").alias("number"), "x.words", "x.counts")
        sizes = index.groupBy("own_lang").agg(F.sum(F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).alias("n"))
        words = each.groupBy("own_lang", "words").agg(F.sum("counts").alias("a")).filter(F.col("a") >= least)
        words = scratch.keep(words.withColumn("id", F.monotonically_increasing_id()))
        level = lambda i: F.lit(i).alias("level")
        found = each.join(words, ["own_lang", "words"]).select("shard", level(1), F.col("number").alias("a"), F.col("id").alias("b"))
        found = scratch.keep(found)

        def counted(size: int, known: DataFrame) -> DataFrame:
            """Each shard's frequent n-grams, with their counts ``f`` over all shards."""
            names = list("abc"[:size])
            bodies = index.select("shard", "body").groupBy("shard")
            kind = ", ".join(f"{c} long" for c in ("shard", *names, "n"))
            rows = bodies.cogroup(known.groupBy("shard")).applyInArrow(_grams(size), kind)
            if size == longest:
                return rows.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
            # the shards have summed already: a row each, all of which are needed again
            rows = rows.withColumn("f", F.sum("n").over(Window.partitionBy(*names)))
            return rows.filter(F.col("f") >= least).drop("n")

        pairs = scratch.keep(counted(2, found))
        two = scratch.keep(pairs.groupBy("a", "b").agg(F.first("f").alias("f"))) if longest > 2 else pairs.select("a", "b", "f")
        named = words.select("id", "own_lang", F.col("words").alias("word"), F.col("a").alias("f"))
        word = lambda c: named.select(F.col("id").alias(c), F.col("own_lang").alias(f"lang_{c}"), F.col("word").alias(f"word_{c}"), F.col("f").alias(f"f_{c}"))
        cut = lambda l, r: F.struct(_score("f", l, r).alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E741, E731
        spoken = two.join(word("a"), "a").join(word("b"), "b")
        shown = spoken.select("a", "b", F.col("lang_a").alias("lang"), F.concat_ws(" ", "word_a", "word_b").alias("phrase"), "f", cut("f_a", "f_b").alias("cut"))
        if longest > 2:
            three = scratch.keep(counted(3, found.union(pairs.select("shard", level(2), "a", "b"))))
            inside = three.select("a", "b", "f").union(three.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
            shown = shown.join(inside, ["a", "b"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
            pair = lambda x, y: two.select(F.col("a").alias(x), F.col("b").alias(y), F.col("f").alias(f"f_{x}{y}"))
            long = three.join(pair("a", "b"), ["a", "b"]).join(pair("b", "c"), ["b", "c"]).join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
            first, second = cut("f_a", "f_bc"), cut("f_ab", "f_c")
            weakest = F.when(first["score"] <= second["score"], first).otherwise(second)
            text = F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase")
            shown = shown.select("lang", "phrase", "f", "cut").union(long.select(F.col("lang_a").alias("lang"), text, "f", weakest.alias("cut")))
        order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
        best = shown.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        best = best.join(sizes.withColumnRenamed("own_lang", "lang"), "lang")
        return scratch.result(best.select("lang", "rank", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"))


def _score(a: str, l: str, r: str):  # noqa: E741
    """floor(1000000*a*a/(l*r)) by integers of 38 digits, for counts of up to 15."""
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * whole(a) * whole(a), whole(l) * whole(r))
