"""Scores of whole texts by a hidden Markov language model trained with Baum-Welch."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields, runs

STATES = 8
FREQUENT = 30_000
CLASSES = 2_000
ENDING = 3
ADDED = 0.1
#: Symbols: 0 is the end, 1 to ``frequent`` are words, the rest are classes of rarer words.
END = 0
BATCH_TOKENS = 1_000_000
#: Steps between which the recursions are brought back to a sum of 1, and positions whose moves are added in single precision.
RESCALED, ADDED_ROWS = 4, 65_536
#: Positions whose emissions are counted at once; their tables fit a core's own cache.
COUNTED_ROWS = 32_768
#: How far a round goes, where 1 is Baum-Welch's own step; near 2 the rounds swing to and fro.
FURTHER = 1.5
FLUSH = 500_000


@dataclass
class Parameters:
    """Initial, transition and emission probabilities; emissions by symbol, then state."""

    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return (text or "").encode().lower().split()


def word_class(word: bytes, frequent: int, classes: int) -> int:
    return frequent + 1 + zlib.crc32(word[-ENDING:]) % classes


class Room:
    """Tables of a row per position that groups use in turn, so that not each has to be given fresh memory."""

    def __init__(self) -> None:
        self._kept: list[np.ndarray] = []

    def tables(self, rows: int, states: int, kind: np.dtype) -> list[np.ndarray]:
        """Three of so many rows and one of ``ADDED_ROWS``, with any numbers in them."""
        if not self._kept or len(self._kept[0]) < rows or self._kept[0].shape[1] != states or self._kept[0].dtype != kind:
            self._kept.clear()  # before the new ones are made
            self._kept += [np.empty((n, states), kind) for n in (rows, rows, rows, ADDED_ROWS)]
        return [*(x[:rows] for x in self._kept[:3]), self._kept[3]]


class Ragged:
    """Sequences of differing lengths laid out step by step, longest first, without padding."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        ends = lengths[self.order]
        self._steps(ends)
        self.symbols = np.empty(self.at[-1], np.int64)
        if len(self.active):
            behind = np.cumsum(ends) - ends
            step = np.arange(self.at[-1]) - np.repeat(behind, ends)
            place = np.take(self.at, step) + np.repeat(np.arange(len(ends)), ends)
            self.symbols[place] = np.concatenate([sequences[k] for k in self.order])

    def _steps(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # sequences longer than each step
        self.at = np.r_[0, np.cumsum(self.active)]

    @classmethod
    def laid_out(cls, symbols: np.ndarray, lengths: np.ndarray) -> Ragged:
        """Of symbols and lengths as another one has them; its order is theirs."""
        own = cls.__new__(cls)
        own.order = np.arange(len(lengths))
        own._steps(lengths)
        own.symbols = symbols
        return own

    def forward(self, p: Parameters, alphas: np.ndarray | None = None, scales: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each sequence by the scaled forward recursion."""
        logs = np.zeros(len(self.order))
        a, ones = None, np.ones(len(p.start), p.emits.dtype)
        for t, n in enumerate(self.active):
            e = np.take(p.emits, self.symbols[self.at[t] : self.at[t + 1]], axis=0)
            a = e * p.start if a is None else a[:n].dot(p.moves) * e
            c = a.dot(ones)
            a /= c[:, None]
            logs[:n] += np.log10(c)
            if alphas is not None:
                alphas[self.at[t] : self.at[t + 1]] = a
                scales[self.at[t] : self.at[t + 1]] = c
        out = np.empty_like(logs)
        out[self.order] = logs
        return out

    def expected(self, p: Parameters, room: Room | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of starts, moves and emissions (by state, then symbol); ``whole`` is the log10 probability of all.

        A step is two products forward and two backward: emissions are relative to a symbol's largest, so that sums need to be
        brought back only every few steps, and all that is counted per position is divided by its sum for many positions at once.
        Where a sum still leaves the range of the numbers, the group is done step by step in double precision.
        """
        k, total = len(p.start), int(self.at[-1])
        if not total:
            self.whole = 0.0
            return np.zeros(k), np.zeros((k, k)), np.zeros((k, len(p.emits)))
        largest = p.emits.max(axis=1)
        own, alpha, beta, ahead_of = (room or Room()).tables(total, k, p.emits.dtype)
        np.take(p.emits / largest[:, None], self.symbols, axis=0, out=own, mode="clip")  # much faster than an index of rows
        last = self.at[self.lengths[self.lengths > 0] - 1] + np.arange((self.lengths > 0).sum())
        beta[last] = 1
        scale, sums, ones = np.ones(total, own.dtype), np.empty(total, own.dtype), np.ones(k, own.dtype)
        counts = np.zeros((k, len(p.emits)))
        spans = list(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True))
        np.multiply(own[: spans[0][1]], p.start, out=alpha[: spans[0][1]])
        with np.errstate(all="ignore"):
            for t in range(1, len(spans)):
                (lo, hi), begin = spans[t], spans[t - 1][0]
                a = alpha[lo:hi]
                np.dot(alpha[begin : begin + hi - lo], p.moves, out=a)  # half the time of np.matmul on a few rows
                a *= own[lo:hi]
                if t % RESCALED == 0:
                    c = scale[lo:hi] = a.dot(ones)
                    a /= c[:, None]
            back = np.ascontiguousarray(p.moves.T)
            for t in range(len(spans) - 1, 0, -1):
                (lo, hi), begin = spans[t], spans[t - 1][0]
                ahead = own[lo:hi]
                ahead *= beta[lo:hi]  # from here on emission times beta
                b = beta[begin : begin + hi - lo]
                np.dot(ahead, back, out=b)
                if t % RESCALED == 0:
                    b /= b.dot(ones)[:, None]
            ends = alpha[last] @ ones
            for lo in range(0, total, COUNTED_ROWS):
                part = slice(lo, lo + COUNTED_ROWS)
                gammas = np.multiply(alpha[part], beta[part], out=beta[part])
                sums[part] = gammas @ ones
                weights = np.ascontiguousarray(gammas[:, :-1].T)
                weights /= sums[part]
                for count, weight in zip(counts, weights.astype(np.float64), strict=False):
                    np.add.at(count, self.symbols[part], weight)
            logs = [np.log10(x, dtype=np.float64).sum() for x in (scale[scale != 1], ends)]
        if not (np.isfinite(sums).all() and (sums > 0).all() and np.isfinite(logs).all()):
            return self.expected_by_step(Parameters(*(x.astype(np.float64) for x in (p.start, p.moves, p.emits))))
        each = np.bincount(self.symbols, minlength=len(p.emits))
        self.whole = float(sum(logs) + each[each > 0] @ np.log10(largest, dtype=np.float64)[each > 0])
        first = spans[0][1]
        before = np.arange(first, total) - np.repeat(self.active[:-1], self.active[1:])  # the place of the step before
        scale *= sums
        moves = np.zeros((k, k))
        for lo in range(first, total, ADDED_ROWS):
            part, places = slice(lo, lo + ADDED_ROWS), before[lo - first : lo - first + ADDED_ROWS]
            own[part] /= np.repeat(scale[part], k).reshape(-1, k)
            moves += np.take(alpha, places, axis=0, out=ahead_of[: len(places)], mode="clip").T @ own[part]
        # each position counts 1 over all states
        counts[-1] = np.maximum(each - counts[:-1].sum(axis=0), 0)
        return (beta[:first] / sums[:first, None]).sum(axis=0), moves * p.moves, counts

    def expected_by_step(self, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, every step brought back to a sum of 1."""
        k, total = len(p.start), int(self.at[-1])
        gammas, scales = np.empty((total, k), p.emits.dtype), np.empty(total, p.emits.dtype)
        self.whole = float(self.forward(p, gammas, scales).sum())
        moves = np.zeros((k, k))
        back = None
        for t in range(len(self.active) - 1, -1, -1):
            own = slice(self.at[t], self.at[t + 1])
            if back is not None:
                n = len(back)
                moves += gammas[own][:n].T @ back
                gammas[own][:n] *= back @ p.moves.T
            g = gammas[own]
            if t:
                # back carries emission times beta over scale for the sequences alive at this step
                beta = np.ones_like(g)
                if back is not None:
                    beta[: len(back)] = back @ p.moves.T
                back = p.emits[self.symbols[own]] * beta / scales[own][:, None]
        start = gammas[: self.active[0]].sum(axis=0) if total else np.zeros(k)
        counts = np.stack([np.bincount(self.symbols, weights=gammas[:, i], minlength=len(p.emits)) for i in range(k)])
        return start, moves * p.moves, counts


def reestimate(start: np.ndarray, moves: np.ndarray, counts: np.ndarray, common: np.ndarray) -> Parameters:
    """Probabilities of expected counts, a little smoothed; emissions towards ``common``."""
    k = len(start)
    start = (start + 1 / k) / (start.sum() + 1)
    moves = (moves + 1 / k) / (moves.sum(axis=1, keepdims=True) + 1)
    emits = (counts + 10 * common) / (counts.sum(axis=1, keepdims=True) + 10)
    return Parameters(start, moves, np.ascontiguousarray(emits.T))


def beyond(old: Parameters, new: Parameters, step: float) -> Parameters:
    """From ``old`` in the direction of ``new``, ``step`` times as far, in the logarithms of the probabilities."""

    def moved(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
        x = np.exp(np.log(a) + step * (np.log(b) - np.log(a)))
        return x / x.sum(axis=axis, keepdims=True)

    return Parameters(moved(old.start, new.start, 0), moved(old.moves, new.moves, 1), moved(old.emits, new.emits, 0))


def first_parameters(sample: list[np.ndarray], states: int, common: np.ndarray, rounds: int, seed: int = 7) -> Parameters:
    """Parameters to start from, by rounds over a sample, with states that last at first."""
    draw = np.random.default_rng(seed)
    emits = common * draw.uniform(0.5, 1.5, (states, len(common)))
    moves = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    p = Parameters(np.full(states, 1 / states), moves, np.ascontiguousarray((emits / emits.sum(axis=1, keepdims=True)).T))
    ragged = Ragged(sample)
    for _ in range(rounds if len(ragged.symbols) else 0):
        p = reestimate(*ragged.expected(p), common)
    return p


def _flat(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words in turn, as a dictionary array, and each text's number of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    of, flat = pc.list_parent_indices(split), split.flatten()
    some = pc.not_equal(flat, "")  # blanks at either end leave an empty one
    lengths = np.bincount(of.filter(some).to_numpy(), minlength=len(texts))
    return flat.filter(some).dictionary_encode(), lengths


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[pa.Table] = []
    size = kept = 0

    def merged() -> pa.Table:
        table = pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return table.rename_columns(["token", "n"]).cast(pa.schema([("token", pa.string()), ("n", pa.int64())]))

    for batch in batches:
        for part in runs(batch, batch.schema.names[0]):
            flat, _ = _flat(part.column(0))
            n = np.bincount(flat.indices.to_numpy(), minlength=len(flat.dictionary))
            parts.append(pa.table({"token": flat.dictionary, "n": n}))
            size += len(n)
            if size - kept > FLUSH:
                parts = [merged()]
                size = kept = parts[0].num_rows
                if kept > FLUSH:
                    yield from parts[0].to_batches(FLUSH)
                    parts, size, kept = [], 0, 0
    if parts:
        yield from merged().to_batches(FLUSH)


def _symbols(distinct: pa.Array, commonest: pa.Array, frequent: int, classes: int) -> np.ndarray:
    """Words' symbols: the place among the commonest words, from 1, or else the class."""
    place = pc.index_in(distinct, value_set=commonest)
    own = pc.add(place.fill_null(0), 1).to_numpy().astype(np.uint16)
    rarer = place.is_null()
    endings = pc.binary_slice(distinct.filter(rarer), -ENDING, None).dictionary_encode()
    class_of = np.array([word_class(e, frequent, classes) for e in endings.dictionary.to_pylist()], np.uint16)
    own[rarer.to_numpy(zero_copy_only=False)] = class_of[endings.indices.to_numpy()]
    return own


def _encoded(shared, frequent: int, classes: int, known: float, id_col: str, text_col: str):
    """Texts as symbols, with what all but the rarer words' own counts add to the scores, and the rarer words.

    Each distinct word of a run of texts is looked up once, all of them together; each distinct ending of the others gives its class once.
    """
    names = [id_col, "held_out", "n_tokens", "n_rare", "base", "in_class", "symbols", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, of_class = shared.value
        commonest = pa.array(words, pa.binary())
        base_of = np.full(frequent + 1 + classes, -np.log10(known))
        base_of[: len(counts)] += np.log10(counts + ADDED)
        class_of = np.r_[np.zeros(frequent + 1), -np.log10(of_class)]
        for batch in batches:
            for part in runs(batch, text_col):
                flat, lengths = _flat(part.column(text_col))
                own = _symbols(flat.dictionary.cast(pa.binary()), commonest, frequent, classes)
                codes = flat.indices.to_numpy()
                ends = np.cumsum(lengths + 1)
                symbols = np.zeros(ends[-1], "<u2")  # the end stays 0
                inside = np.ones(len(symbols), bool)
                inside[ends - 1] = False
                symbols[inside] = own[codes]
                is_rare = own[codes] > frequent
                n_rare = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[is_rare], minlength=len(lengths))
                begins = ends - lengths - 1
                rare = flat.filter(pa.array(is_rare)).cast(pa.string())
                rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_rare)], pa.int32()), rare)
                columns = [
                    pa.array(lengths + 1, pa.int64()),
                    pa.array(n_rare, pa.int64()),
                    pa.array(np.add.reduceat(base_of[symbols], begins)),
                    pa.array(np.add.reduceat(class_of[symbols], begins)),
                    pa.array([symbols[i:j].tobytes() for i, j in zip(begins, ends, strict=True)], pa.binary()),
                    pc.binary_join(rare, " "),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=names)

    return run


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("symbols")]


def _groups(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sequences of like lengths with about ``BATCH_TOKENS`` symbols together, and their places.

    With like lengths a group's steps are wide up to its end, and few.
    """
    if not sequences:
        return
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(sizes, kind="stable")
    group = (np.cumsum(sizes[order]) - 1) // BATCH_TOKENS
    for part in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        yield part, [sequences[i] for i in part]


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of sequences as every round reads them."""
    for batch in batches:
        for _, group in _groups(_sequences(batch)):
            ragged = Ragged(group)
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (ragged.symbols.astype("<u2"), ragged.lengths.astype("<i8"))]
            yield pa.RecordBatch.from_arrays(columns, names=["symbols", "lengths"])


def _expect(shared, states: int):
    """A task's expected counts: a row per symbol; -1 the starts, from -2 down the moves of each state, then the log10 probability."""
    names = ["symbol", *(f"c{i}" for i in range(states))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        p = Parameters(*(x.astype(np.float32) for x in (p.start, p.moves, p.emits)))
        start, moves, counts, whole = np.zeros(states), np.zeros((states, states)), np.zeros((states, len(p.emits))), np.zeros(states)
        room = Room()
        for batch in batches:
            for symbols, lengths in zip(batch.column("symbols"), batch.column("lengths"), strict=True):
                ragged = Ragged.laid_out(np.frombuffer(symbols.as_py(), "<u2").astype(np.int64), np.frombuffer(lengths.as_py(), "<i8"))
                for total, part in zip((start, moves, counts), ragged.expected(p, room), strict=True):
                    total += part
                whole[0] += ragged.whole
        some = np.flatnonzero(counts.any(axis=0))
        if len(some):
            rows = np.concatenate([start[None], moves, whole[None], counts[:, some].T])
            symbols = np.r_[-1 - np.arange(states + 2), some]
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=names)

    return run


def _scored(shared):
    """The texts' log10 probabilities as symbols, in place of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            out = np.empty(batch.num_rows)
            for places, group in _groups(_sequences(batch)):
                out[places] = Ragged(group).forward(p)
            yield batch.drop_columns(["symbols"]).append_column("path", pa.array(out))

    return run


def _trained(train: DataFrame, p: Parameters, rounds: int, least: int, gain: float, common: np.ndarray, spark: SparkSession) -> Parameters:
    """Rounds over all texts: ``least``, then until one gains less than a share ``gain`` of their log10 probability.

    Each round goes further than Baum-Welch's own step. The next one shows the probability of where that led; if it fell, it
    counts for nothing but to go back to that step.
    """
    with Scratch(spark) as scratch:
        laid = scratch.keep(train.select("symbols").mapInArrow(_laid_out, "symbols binary, lengths binary"))
        return _rounds(laid, p, rounds, least, gain, common, spark)


def _rounds(laid: DataFrame, p: Parameters, rounds: int, least: int, gain: float, common: np.ndarray, spark: SparkSession) -> Parameters:
    states, before, own = len(p.start), -np.inf, p
    kinds = "symbol long, " + ", ".join(f"c{i} double" for i in range(states))
    for done in range(rounds):
        counts = laid.mapInArrow(_expect(spark.sparkContext.broadcast(p), states), kinds)
        sums = [F.sum(f"c{i}").alias(f"c{i}") for i in range(states)]
        rows = counts.groupBy("symbol").agg(*sums).toPandas()  # a row per symbol and state, whatever the input
        if rows.empty:
            break
        table = rows.set_index("symbol").to_numpy()
        at = rows["symbol"].to_numpy()
        emitted = np.zeros((states, len(common)))
        emitted[:, at[at >= 0]] = table[at >= 0].T
        by = {s: table[i] for i, s in enumerate(at) if s < 0}
        whole = by[-2 - states][0]
        if whole < before:
            p = own
            continue
        own = reestimate(by[-1], np.stack([by[-2 - i] for i in range(states)]), emitted, common)
        if done >= least and whole - before < gain * abs(whole):
            p = own
            break
        p, before = beyond(p, own, FURTHER), whole
    return p


def score_texts(
    docs: DataFrame,
    held_out: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    frequent: int = FREQUENT,
    classes: int = CLASSES,
    rounds: int = 60,
    least_rounds: int = 5,
    gain: float = 1e-4,
    sample_texts: int = 0,
    sample_rounds: int = 15,
) -> DataFrame:
    """Scores every text under a hidden Markov model of all texts for which the SQL ``held_out`` is false.

    The model emits symbols: the ``frequent`` commonest words, the end of a text, and ``classes`` of all rarer
    words by their last letters. A rarer word's probability is that of its class times its share of the class,
    (count + 0.1) / (class count + 0.1 * (class words + 1)), where the counts of all words are kept in a table and
    joined; unseen words share the one extra word. Baum-Welch: in each round every training text is run forward
    and backward, and the tasks' expected counts are added; the new parameters are taken a little beyond those of the counts, which
    the next round takes back if the probability fell. The first parameters are random, by a fixed seed, about the
    whole symbol counts. After ``least_rounds``, the rounds go on until one gains less than the share ``gain`` of the
    log10 probability of all training texts, or until ``rounds``. No step takes a sample, unless ``sample_texts`` asks
    for ``sample_rounds`` over so many training texts to start from. The score is the exact log10 probability of the
    whole text, by the scaled forward recursion.

    Returns the id column, ``held_out``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``,
    ``base_score`` (add-0.1 unigrams) and ``score``. A null text is empty: the end alone. Repeated rows each count
    and each get a row. Without training texts every word is unseen. Other columns are not read. An empty table
    gives an empty result.
    """
    if frequent + classes >= 1 << 16:
        raise ValueError("frequent + classes must be under 65,536")
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("own_id"), F.expr(held_out).alias("held_out"), F.col(text_col).alias("own_text"))
    with Scratch(spark) as scratch:
        train = own.filter("not held_out")
        counts = train.select("own_text").mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
        counts = scratch.keep(counts)
        total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
        ends = train.count()
        train_tokens, distinct = (total or 0) + ends, distinct + (ends > 0)
        known = train_tokens + ADDED * (distinct + 1)
        top = counts.orderBy(F.desc("n"), "token").limit(frequent).collect()  # bounded by the parameter
        least = (top[-1].n, top[-1].token) if len(top) == frequent else None
        frequent, words = len(top), [r.token.encode() for r in top]  # no symbol without a word
        weights = np.array([ends, *(r.n for r in top)], float)

        ending = F.substring(F.encode("token", "utf-8"), -ENDING, ENDING)
        is_rare = F.lit(False) if least is None else (F.col("n") < least[0]) | ((F.col("n") == least[0]) & (F.col("token") > least[1]))
        rare_counts = counts.filter(is_rare)
        by_class = rare_counts.groupBy(F.pmod(F.crc32(ending), F.lit(classes)).cast("int").alias("class"))
        by_class = by_class.agg(F.sum("n").alias("class_n"), F.count("*").alias("class_words")).collect()
        class_n, class_words = np.zeros(classes), np.zeros(classes)
        for r in by_class:
            class_n[r["class"]], class_words[r["class"]] = r.class_n, r.class_words
        mass = np.r_[weights, class_n] + ADDED
        common = mass / mass.sum()

        shared = spark.sparkContext.broadcast((words, weights, class_n + ADDED * (class_words + 1)))
        kinds = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_rare", T.LongType()), ("base", T.DoubleType())]
        kinds += [("in_class", T.DoubleType()), ("symbols", T.BinaryType()), ("rare", T.StringType())]
        texts = own.mapInArrow(_encoded(shared, frequent, classes, known, "own_id", "own_text"), fields(own, "own_id", *kinds))
        texts = scratch.keep(texts.withColumn("row_id", F.monotonically_increasing_id()))

        taught = texts.filter("not held_out")
        first = taught.select("symbols").orderBy(F.xxhash64("symbols"), "symbols").limit(sample_texts).collect()
        p = first_parameters([np.frombuffer(r.symbols, np.uint16) for r in first], states, common, sample_rounds)
        p = _trained(taught, p, rounds, least_rounds, gain, common, spark)
        kinds = T.StructType([*texts.drop("rare", "symbols").schema, T.StructField("path", T.DoubleType())])
        scored = texts.drop("rare").mapInArrow(_scored(spark.sparkContext.broadcast(p)), kinds)

        # A rarer word adds the same logarithm of its count to both scores; all else is in the texts' own columns.
        each = texts.filter("n_rare > 0").select("row_id", F.explode(F.split("rare", " ")).alias("token"))
        each = each.join(rare_counts, "token", "left")
        rare = each.groupBy("row_id").agg(F.count("n").alias("known_rare"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + ADDED)).alias("of_counts"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        out = scored.join(rare, "row_id", "left")
        n_known = F.col("n_tokens") - F.col("n_rare") + zero("known_rare") - (0 if ends else 1)
        return scratch.result(
            out.select(
                F.col("own_id").alias(id_col), "held_out", "n_tokens", n_known.alias("n_known"),
                F.lit(train_tokens).cast("long").alias("train_tokens"),
                (F.col("base") + zero("of_counts")).alias("base_score"),
                (F.col("path") + F.col("in_class") + zero("of_counts")).alias("score"),
            )
        )
