"""Removal of passages that recur anywhere, located by sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache
from itertools import compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields, slices

WINDOW = 35
GRAM = 8
SHARD_WORDS = 1_000_000
UNIFORM, MIXED = 1, 2
#: The bits of a gram's hash that go with a text to its shard, to tell texts without any recurring gram.
SHORT = 0x7FFFFFFF
#: Odd multipliers of the two polynomial hashes, and their inverses modulo 2 ** 64.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSE = tuple(pow(f, -1, 1 << 64) for f in FACTORS)


@cache
def _powers_to(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _powers(base: int, n: int) -> np.ndarray:
    return _powers_to(base, 1 << max(12, n.bit_length()))[:n]


class WordHashes:
    """Hashes of any spans of a text's words, from prefix sums modulo 2 ** 64."""

    def __init__(self, words: list[bytes]) -> None:
        self.n = len(words)
        each = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
        self._sums, self._back = [], []
        for factor, inverse in zip(FACTORS, _INVERSE, strict=True):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(each * _powers(factor, self.n), out=sums[1:])
            self._sums.append(sums)
            self._back.append(_powers(inverse, self.n + 1))

    def spans(self, begin: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        h = (self._sums[which][end] - self._sums[which][begin]) * self._back[which][begin]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def anchors(hashes: WordHashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the word grams that stand for the windows around them.

    In every window the gram with the smallest hash, the first of equals, is chosen. So two equal windows
    have the same chosen gram at the same place, whatever surrounds them.
    """
    if hashes.n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(hashes.n - gram + 1)
    grams = hashes.spans(at, at + gram, 0)
    wide = window - gram + 1
    chosen = []
    for i in range(0, hashes.n - window + 1, 100_000):
        part = grams[i : min(i + 100_000, hashes.n - window + 1) + wide - 1]
        least = np.lib.stride_tricks.sliding_window_view(part, wide).argmin(axis=1)
        chosen.append(least + np.arange(i, i + len(least)))
    places = np.unique(np.concatenate(chosen))
    return places, grams[places]


def _around(places: np.ndarray, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start around each place, all windows that hold the gram there."""
    return np.maximum(places + gram - window, 0), np.minimum(places, n - window)


def _covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions are in a range, ends included."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, last + 1, -1)
    return np.cumsum(steps[:n]) > 0


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64), pa.int64())


def _prepare(window: int, gram: int, id_col: str, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=7).compress
        for batch in batches:
            for part, texts in slices(batch, text_col):
                bodies, counts, grams, blocks = [], [], [], []
                for text in texts:
                    words = (text or "").encode().split()
                    bodies.append(pack(b" ".join(words)))
                    counts.append(len(words))
                    if len(words) < window:
                        grams.append([])
                        blocks.append([])
                        continue
                    hashes = WordHashes(words)
                    places, own = anchors(hashes, window, gram)
                    first, last = _around(places, len(words), window, gram)
                    whole = hashes.spans(first, last + window, 1) + ((places - first) * 64 + (last - places)).astype(np.uint64)
                    grams.append(own.view(np.int64))
                    blocks.append(whole.view(np.int64))
                kind = pa.list_(pa.int64())
                columns = [part.column(0), pa.array(bodies, pa.binary()), pa.array(counts, pa.int64()), pa.array(grams, kind), pa.array(blocks, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "body", "n_words", "anchors", "blocks"])

    return run


def _words(body: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(body).split()


def _known(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The lists of a column of integers, one by one."""
    for chunk in column.chunks:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _open_windows(window: int, gram: int) -> Callable:
    """The hashes of all windows of a shard around grams that recur in differing company."""
    schema = pa.schema([("shard", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64())])

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        mixed = np.sort(_column(found, "anchor")[_column(found, "state") == MIXED])
        ones, twos = [], []
        short = np.unique(mixed & SHORT).astype(np.int32)
        for i, own in enumerate(_lists(docs.column("short"))):
            if not _known(own, short).any():
                continue
            hashes = WordHashes(_words(docs.column("body")[i].as_py()))
            places, grams = anchors(hashes, window, gram)
            hit = _known(grams.view(np.int64), mixed)
            starts = np.flatnonzero(_covered(*_around(places[hit], hashes.n, window, gram), hashes.n))
            ones.append(hashes.spans(starts, starts + window, 0))
            twos.append(hashes.spans(starts, starts + window, 1))
        if not ones:
            return schema.empty_table()
        both = np.stack([np.concatenate(ones), np.concatenate(twos)], axis=1)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        new = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1)])
        counts = np.diff(np.r_[new, len(both)])
        shard = pa.array(np.full(len(new), docs.column("shard")[0].as_py(), np.int64))
        return pa.table([shard, _signed(both[new, 0].copy()), _signed(both[new, 1].copy()), pa.array(counts, pa.int64())], schema=schema)

    return run


def _locate(window: int, gram: int, schema: pa.Schema, id_col: str) -> Callable:
    """Puts a shard's recurring passages in one automaton and streams all its documents through it."""

    def passages(words: list[bytes], uniform: np.ndarray, repeated: np.ndarray, same: int) -> list[tuple[int, int]]:
        hashes = WordHashes(words)
        places, grams = anchors(hashes, window, gram)
        starts = _covered(*_around(places[_known(grams.view(np.int64), uniform)], hashes.n, window, gram), hashes.n)
        if len(repeated):
            at = np.arange(hashes.n - window + 1)
            one, two = hashes.spans(at, at + window, 0).view(np.int64), hashes.spans(at, at + window, 1).view(np.int64)
            near = np.flatnonzero(_known(one, repeated["w1"]))
            first = np.searchsorted(repeated["w1"], one[near])
            for step in range(same):  # windows that agree in the first hash stand next to each other
                at = np.minimum(first + step, len(repeated) - 1)
                starts[near[(repeated["w1"][at] == one[near]) & (repeated["w2"][at] == two[near])]] = True
        edges = np.flatnonzero(np.diff(np.r_[0, starts.astype(np.int8), 0]))
        return [(int(a), int(b) + window - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        state = _column(found, "state")
        uniform = np.sort(_column(found, "anchor")[state == UNIFORM])
        short = np.unique(_column(found, "anchor")[state > 0] & SHORT).astype(np.int32)
        repeated = np.empty(int((state == 0).sum()), [("w1", np.int64), ("w2", np.int64)])
        repeated["w1"], repeated["w2"] = _column(found, "anchor")[state == 0], _column(found, "second")[state == 0]
        repeated.sort()
        same = int(np.unique(repeated["w1"], return_counts=True)[1].max(initial=0))
        numbers: dict[bytes, int] = {}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        bodies, counts = docs.column("body"), docs.column("n_words")
        for i, own in enumerate(_lists(docs.column("short"))):
            if _known(own, short).any():
                words = _words(bodies[i].as_py())
                for a, b in passages(words, uniform, repeated, same):
                    automaton.add_word(tuple(numbers.setdefault(w, len(numbers) + 1) for w in words[a:b]))
        if len(automaton):
            automaton.make_automaton()
        removed, kept, number = [], [], numbers.get
        for i in range(docs.num_rows):
            words = _words(bodies[i].as_py())
            cover = np.zeros(len(words) + 1, np.int64)
            if len(automaton) and len(words) >= window:
                for end, length in automaton.iter(tuple(map(number, words, repeat(0)))):
                    cover[end + 1 - length] += 1
                    cover[end + 1] -= 1
            stays = np.cumsum(cover[:-1]) == 0
            removed.append(len(words) - int(stays.sum()))
            kept.append(b" ".join(compress(words, stays.tolist())).decode())
        return pa.table([docs.column(id_col), counts, pa.array(removed, pa.int64()), pa.array(kept, pa.string())], schema=schema)

    return run


def remove_recurring(
    docs: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Removes each word in a run of ``window`` words that also starts anywhere else, in any document.

    1. From each window one gram of ``gram`` words is chosen by its content; the chosen grams are counted
       over all documents. One that occurs once cannot be in a recurring window. Where all occurrences of a
       gram have equal company as far as windows reach, all windows around it recur.
    2. Windows around the other recurring grams are counted themselves, by hashes of 128 bits.
    3. Documents are dealt to shards. Each shard joins its recurring windows to passages, compiles them into
       one automaton over word numbers and streams all its documents through it; the words in the
       occurrences go.

    Returns the id column, ``n_words``, ``n_removed`` and the columns of ``carry`` (expressions on those and
    on ``text``, the words kept, joined by one blank; by default ``text`` itself). Null, empty and short texts
    have nothing removed; a null text is empty. Repeated rows are documents of their own, so all their windows
    recur. Other columns are not read. An empty table gives an empty result. A shard has about
    ``shard_words`` words, or one longer document.
    """
    carry = {"text": F.col("text")} if carry is None else carry
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    with Scratch(spark) as scratch:
        longs = T.ArrayType(T.LongType())
        more = [("body", T.BinaryType()), ("n_words", T.LongType()), ("anchors", longs), ("blocks", longs)]
        texts = own.mapInArrow(_prepare(window, gram, "own_id", "own_text"), fields(own, "own_id", *more))
        texts = scratch.keep(texts.withColumn("row_id", F.monotonically_increasing_id()))
        total = texts.agg(F.sum("n_words")).first()[0] or 0
        shards = max(-(-total // shard_words), int(spark.conf.get("spark.sql.shuffle.partitions")))
        texts = texts.withColumn("shard", F.pmod(F.xxhash64("row_id"), F.lit(shards)))
        texts = texts.withColumn("short", F.transform("anchors", lambda x: x.bitwiseAND(F.lit(SHORT)).cast("int")))

        each = texts.select("shard", F.explode(F.arrays_zip("anchors", "blocks")).alias("x")).select("shard", "x.*")
        seen = each.groupBy(F.col("anchors").alias("anchor")).agg(
            F.count("*").alias("n"), F.min("blocks").alias("low"), F.max("blocks").alias("high")
        )
        state = F.when(F.col("low") == F.col("high"), UNIFORM).otherwise(MIXED).cast("long")
        recur = seen.filter("n > 1").select("anchor", state.alias("state"))
        places = each.select("shard", F.col("anchors").alias("anchor")).distinct()
        found = scratch.keep(places.join(recur, "anchor").select("shard", "anchor", "state"))

        by_shard = lambda df: df.groupBy("shard")
        bodies = texts.select("shard", "body", "short")
        windows = by_shard(bodies).cogroup(by_shard(found)).applyInArrow(_open_windows(window, gram), "shard long, w1 long, w2 long, n long")
        windows = scratch.keep(windows)
        twice = windows.groupBy("w1", "w2").agg(F.sum("n").alias("all")).filter("`all` > 1").drop("all")
        again = windows.select("shard", "w1", "w2").join(twice, ["w1", "w2"])
        none = F.lit(0).cast("long")
        known = found.select("shard", "anchor", none.alias("second"), "state")
        known = known.union(again.select("shard", "w1", "w2", none))

        out = fields(texts, "own_id", ("n_words", T.LongType()), ("n_removed", T.LongType()), ("text", T.StringType()))
        from pyspark.sql.pandas.types import to_arrow_schema

        run = _locate(window, gram, to_arrow_schema(out), "own_id")
        left = by_shard(texts.select("shard", "own_id", "body", "n_words", "short")).cogroup(by_shard(known)).applyInArrow(run, out)
        columns = [c.alias(n) for n, c in carry.items()]
        return scratch.result(left.select(F.col("own_id").alias(id_col), "n_words", "n_removed", *columns))
