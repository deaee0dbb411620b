"""Toxicity by a classifier chain over labelled categories."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields, slices

GRAM = 4
FEATURES = 100
FOLDS = 3
SAMPLE = 10_000
PENALTY = 1e-5
FLUSH = 300_000
WORD_CACHE = 50_000
#: Characters judged at once.
JUDGED_CHARS = 500_000
_WORDS = re.compile(r"[^\W\d_]+")


def grams(word: str) -> set[str]:
    """The letter grams of a word with a mark at either end."""
    w = f"_{word}_"
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def _counted(n_labels: int):
    """How many texts of a task with each label, and how many positive ones, have each gram."""
    names = ["gram", *(x for i in range(n_labels) for x in (f"n{i}", f"y{i}"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Counter() for _ in names[1:]]

        def out() -> pa.RecordBatch:
            keys = sorted(set().union(*sums))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in sums)], names=names)

        for batch in batches:
            labels = [batch.column(f"label{i}").to_pylist() for i in range(n_labels)]
            for row, text in enumerate(batch.column("own_text")):
                found = set().union(*map(grams, set(_WORDS.findall((text.as_py() or "").lower()))))
                for i in range(n_labels):
                    if labels[i][row] is not None:
                        sums[2 * i].update(found)
                        if labels[i][row]:
                            sums[2 * i + 1].update(found)
            if len(sums[0]) > FLUSH:
                yield out()
                for s in sums:
                    s.clear()
        if any(sums):
            yield out()

    return run


class Reader:
    """The numbers of the chosen grams in texts; what a word has is kept once known."""

    def __init__(self, chosen: Sequence[str]) -> None:
        self._number = {g: i for i, g in enumerate(chosen)}
        self._words: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[bool, np.ndarray]:
        """Whether a text has a letter, and the distinct numbers in it."""
        words = set(_WORDS.findall((text or "").lower()))
        if len(self._words) > WORD_CACHE:
            self._words.clear()
        found: set[int] = set()
        for w in words:
            own = self._words.get(w)
            if own is None:
                own = self._words[w] = tuple(self._number[g] for g in grams(w) if g in self._number)
            found.update(own)
        return bool(words), np.array(sorted(found), np.int64)


@dataclass
class Linear:
    """A logistic model over grams and earlier probabilities; without weights, a constant probability."""

    bias: float
    grams: np.ndarray
    earlier: np.ndarray
    constant: float | None = None

    def __call__(self, rows: np.ndarray, columns: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of texts: ``rows`` and ``columns`` are the texts' numbers and their grams'."""
        if self.constant is not None:
            return np.full(len(earlier), self.constant)
        z = self.bias + np.bincount(rows, weights=self.grams[columns], minlength=len(earlier)) + earlier @ self.earlier
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_linear(rows: np.ndarray, columns: np.ndarray, earlier: np.ndarray, y: np.ndarray, features: int, penalty: float, rounds: int = 25) -> Linear:
    """Logistic regression with an L2 penalty by Newton steps, each solved by conjugate gradients."""
    n, k = len(y), earlier.shape[1]
    if not n or y.min() == y.max():
        return Linear(0.0, np.zeros(features), np.zeros(k), float(y[0]) if n else 0.0)
    ridge = np.r_[np.full(features + k, penalty * n), 1e-9]

    def forth(w: np.ndarray) -> np.ndarray:
        return w[-1] + np.bincount(rows, weights=w[columns], minlength=n) + earlier @ w[features:-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(columns, weights=r[rows], minlength=features), r @ earlier, r.sum()]

    def loss(w: np.ndarray) -> float:
        z = forth(w)
        return float((np.logaddexp(0, z) - y * z).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(features + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forth(w), -500, 500)))
        slope = back(p - y) + ridge * w
        curve = p * (1 - p)
        step, r = np.zeros_like(w), -slope
        d, size = r.copy(), r @ r
        for _ in range(40):
            hd = back(curve * forth(d)) + ridge * d
            a = size / (d @ hd)
            step += a * d
            r -= a * hd
            new = r @ r
            if new < 1e-4 * (slope @ slope):
                break
            d, size = r + new / size * d, new
        scale = 1.0
        while (then := loss(w + scale * step)) > now + 1e-4 * scale * (slope @ step) and scale > 1e-4:
            scale /= 2
        w = w + scale * step
        if now - then < 1e-6 * now:
            break
        now = then
    return Linear(w[-1], w[:features], w[features:-1])


@dataclass
class Chain:
    """Linear models in turn: each sees a text's grams and the probabilities of all earlier categories.

    So that a model learns from earlier probabilities as they will be for new texts, its training rows have those of
    models that did not see the row: each category but the last is also trained once for every fold, on the other folds.
    """

    features: int
    folds: int = FOLDS
    penalty: float = PENALTY
    models: list[Linear] = field(default_factory=list)

    def fit(self, texts: list[np.ndarray], fold: np.ndarray, labels: np.ndarray) -> Chain:
        """``texts`` has each row's gram numbers, ``labels`` 0, 1 or NaN for each row and category."""
        n, categories = labels.shape
        sizes = np.array([len(t) for t in texts], np.int64)
        earlier = np.zeros((n, 0))

        def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            some = [texts[i] for i in np.flatnonzero(keep)]
            columns = np.concatenate(some) if some else np.empty(0, np.int64)
            return np.repeat(np.arange(len(some)), sizes[keep]), columns, earlier[keep]

        def fitted(keep: np.ndarray, k: int) -> Linear:
            keep = keep & ~np.isnan(labels[:, k])
            return fit_linear(*part(keep), labels[keep, k], self.features, self.penalty)

        for k in range(categories):
            self.models.append(fitted(np.ones(n, bool), k))
            if k + 1 < categories:
                unseen = np.zeros(n)
                for f in range(self.folds):
                    unseen[fold == f] = fitted(fold != f, k)(*part(fold == f))
                earlier = np.column_stack([earlier, unseen])
        return self

    def __call__(self, texts: list[np.ndarray]) -> np.ndarray:
        """Each text's probability of every category."""
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        columns = np.concatenate(texts) if texts else np.empty(0, np.int64)
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, model(rows, columns, out)])
        return out


def telling_grams(counts: DataFrame, n_labels: int, most: int) -> list[str]:
    """The grams that tell most about each label, by the chi-square statistic; ``counts`` has n and y per label."""
    chosen: set[str] = set()
    for i in range(n_labels):
        # every text with a letter has a mark, so totals are those of the commonest gram at least
        n, y = F.col(f"n{i}").cast("double"), F.col(f"y{i}").cast("double")
        n_all, y_all = counts.agg(F.max(n), F.max(y)).first()
        if not n_all or not y_all:
            continue
        gap = y * n_all - n * y_all
        top = counts.filter(n > 1).select("gram", (gap * gap / (n * (n_all - n + 0.5))).alias("chi"))
        chosen.update(r.gram for r in top.orderBy(F.desc("chi"), "gram").limit(most).collect())
    return sorted(chosen)


def _judged(shared, names: list[str], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, chain, threshold = shared.value
        read = Reader(chosen)
        for batch in batches:
            for part, texts in slices(batch, "own_text", JUDGED_CHARS):
                found = [read(t) for t in texts]
                some = np.array([x for x, _ in found])
                p = chain([x for _, x in found]) * some[:, None]
                columns = [*(part.column(c) for c in kept), *(pa.array(c) for c in p.T), pa.array((p[:, -1] >= threshold) & some)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names, "rejected"])

    return run


def toxic_documents(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str] = ("low_quality", "toxic"),
    threshold: float = 0.4,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    features: int = FEATURES,
    carry: Mapping[str, Column] | None = None,
    carry_text: str | None = None,
) -> DataFrame:
    """Each document's probability for every category of a chain, and whether the last one rejects it.

    ``labels`` has the id and a column of 0, 1 or null per category, the last being toxicity. The chain is fitted on
    at most ``sample`` labelled documents, chosen by a hash of their id and, of rows with the same id, of their text, over the ``features`` letter grams that tell
    most about each category; it judges all documents. Labels of one id that differ count as the largest; labels
    without a document and null ids are left out.

    Returns the id column, the columns of ``carry`` (expressions on those of ``docs``), the text itself as ``carry_text`` if
    that is given (a text in ``carry`` would go to the tasks' Python and back beside it), ``p_<category>`` for each category and ``rejected``. A text without letters, as null or
    empty ones, has probability 0 and is not rejected. Repeated rows each get a row. Where a category's labels are all
    equal, its probability is that label, 0 without any. Other columns are not read. An empty table gives an empty
    result.
    """
    spark, n = docs.sparkSession, len(categories)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("own_id"))
    known = known.agg(*(F.max(F.col(c)).cast("int").alias(f"label{i}") for i, c in enumerate(categories)))
    with Scratch(spark) as scratch:
        chosen = known.join(own.select("own_id"), "own_id", "left_semi")  # ids alone, so that texts are not moved
        chosen = scratch.keep(chosen.orderBy(F.xxhash64("own_id"), "own_id").limit(sample))
        # of the rows of an id, one: the smallest by two hashes of its text, found without moving texts
        place = F.struct(F.xxhash64("own_text").alias("low"), F.xxhash64("own_text", F.lit(1)).alias("high"))
        one = own.join(F.broadcast(chosen.select("own_id")), "own_id", "left_semi").select("own_id", place.alias("place"))
        one = one.groupBy("own_id").agg(F.min("place").alias("least"))
        rows = own.join(F.broadcast(chosen.join(one, "own_id")), "own_id").filter(place == F.col("least")).drop("least")
        rows = rows.dropDuplicates(["own_id"])  # equal in id and text; bounded by the parameter
        rows = scratch.keep(rows.withColumn("fold", F.pmod(F.xxhash64("own_id", F.lit(1)), F.lit(FOLDS)).cast("int")))
        kinds = "gram string, " + ", ".join(f"n{i} long, y{i} long" for i in range(n))
        counts = rows.mapInArrow(_counted(n), kinds).groupBy("gram")
        counts = scratch.keep(counts.agg(*(F.sum(f"{x}{i}").alias(f"{x}{i}") for i in range(n) for x in "ny")))
        grams_chosen = telling_grams(counts, n, features)
        shared = spark.sparkContext.broadcast(grams_chosen)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Reader(shared.value)
            for batch in batches:
                numbers = [reader(t.as_py())[1].astype(np.int32) for t in batch.column("own_text")]
                columns = [pa.array(numbers, pa.list_(pa.int32())), *(batch.column(c) for c in ["fold", *(f"label{i}" for i in range(n))])]
                yield pa.RecordBatch.from_arrays(columns, names=["grams", "fold", *(f"label{i}" for i in range(n))])

        kinds = "grams array<int>, fold int, " + ", ".join(f"label{i} int" for i in range(n))
        table = rows.mapInArrow(read, kinds).toArrow()  # a bounded sample, as numbers of chosen grams
    texts = [np.array(x.as_py(), np.int64) for x in table.column("grams")]
    marks = np.column_stack([table.column(f"label{i}").to_pandas().to_numpy(float) for i in range(n)])
    chain = Chain(len(grams_chosen)).fit(texts, table.column("fold").to_numpy(), marks)
    names = [f"p_{c}" for c in categories]
    carry = carry or {}
    kept = {"own_id": id_col} | {f"carry_{c}": c for c in carry} | ({"own_text": carry_text} if carry_text else {})
    judged = docs.select(F.col(id_col).alias("own_id"), *(c.alias(f"carry_{n}") for n, c in carry.items()), F.col(text_col).alias("own_text"))
    more = [*((c, judged.schema[c].dataType) for c in kept if c != "own_id"), *((c, T.DoubleType()) for c in names), ("rejected", T.BooleanType())]
    model = spark.sparkContext.broadcast((grams_chosen, chain, threshold))
    return judged.mapInArrow(_judged(model, names, list(kept)), fields(judged, "own_id", *more)).withColumnsRenamed(kept)


def quality_and_toxicity(labels: DataFrame) -> DataFrame:
    """The table ``labels`` with low quality as the first category of the chain."""
    return labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic")
