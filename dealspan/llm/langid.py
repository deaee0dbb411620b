"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields, slices

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
#: Documents of one matrix product have about so many characters, and columns.
SLICE_CHARS = 400_000
BLOCK = 8192


@lru_cache(100_000)
def _letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """A random vector of -1 and 1 that depends on the letter alone."""
    return np.random.default_rng([letter, dimensions]).choice(np.array([-1, 1], np.int8), dimensions)


class Alphabet:
    """Numbers for the letters of texts, from 1; 0 is whatever is between words.

    ``vectors[j]`` has the letters' vectors permuted ``j`` times (by a rotation).
    """

    def __init__(self, gram: int, dimensions: int) -> None:
        self.gram, self.dimensions = gram, dimensions
        self._number = np.full(0x110000, -1, np.int32)
        self._letters: list[int] = []
        self._known = np.empty((0, dimensions), np.int8)
        self._learn(np.array([0x20], np.uint32))

    def _learn(self, points: np.ndarray) -> None:
        for c in points.tolist():
            if chr(c).isalpha():
                self._letters.append(c)
                self._number[c] = len(self._letters)
            else:
                self._number[c] = 0

    def __len__(self) -> int:
        return len(self._letters) + 1

    def numbers(self, text: str) -> np.ndarray:
        """A text's letters in lower case, with one 0 for each run of others and at both ends; else empty."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self._number[points]
        if len(out) and out.min() < 0:
            self._learn(np.unique(points[out < 0]))
            out = self._number[points]
        out = np.concatenate(([0], out, [0]))
        keep = (out[1:] > 0) | (out[:-1] > 0)
        out = out[np.r_[True, keep]]
        return out if len(out) > 1 else out[:0]

    def grams(self, numbers: np.ndarray, base: int) -> np.ndarray:
        n = len(numbers) - self.gram + 1
        keys = np.zeros(max(n, 0), np.int64)
        for j in range(self.gram if n > 0 else 0):
            keys = keys * base + numbers[j : j + n]
        return keys

    def vectors(self, keys: np.ndarray, base: int) -> np.ndarray:
        """The vectors of grams: the product of their letters' vectors, each permuted by its place."""
        if len(self._known) < len(self):
            new = [0x20, *self._letters][len(self._known) :]
            self._known = np.concatenate([self._known, np.stack([_letter_vector(c, self.dimensions) for c in new])])
        out = np.ones((len(keys), self.dimensions), np.int8)
        for j in range(self.gram):
            keys, letter = np.divmod(keys, base)
            out *= np.roll(self._known, j, axis=1)[letter]
        return out


def _bundles(alphabet: Alphabet, numbers: list[np.ndarray], groups: np.ndarray) -> np.ndarray:
    """The sum of the texts' gram vectors in each group, of which there are as many as the last one's number."""
    base = len(alphabet)
    keys = [alphabet.grams(x, base) for x in numbers]
    whole = np.concatenate(keys) if keys else np.empty(0, np.int64)
    group = np.repeat(groups, [len(k) for k in keys])
    n = int(groups.max(initial=-1)) + 1
    if base**alphabet.gram <= 2_000_000:
        some = np.flatnonzero(np.bincount(whole, minlength=base**alphabet.gram))
        column = np.empty(base**alphabet.gram, np.int64)
        column[some] = np.arange(len(some))
        column = column[whole]
    else:
        some, column = np.unique(whole, return_inverse=True)
    out = np.zeros((n, alphabet.dimensions), np.float32)
    for at in range(0, len(some), BLOCK):
        part = some[at : at + BLOCK]
        own = (column >= at) & (column < at + len(part)) if len(some) > BLOCK else slice(None)
        counts = np.bincount(group[own] * len(part) + column[own] - at, minlength=n * len(part))
        out += counts.reshape(n, len(part)).astype(np.float32) @ alphabet.vectors(part, base).astype(np.float32)
    return out


def _language_sums(gram: int, dimensions: int):
    """A task's sum of gram vectors for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, sums = Alphabet(gram, dimensions), {}
        for batch in batches:
            for part, texts in slices(batch, "own_text", 20 * SLICE_CHARS):
                names, groups = np.unique(part.column("lang").to_pylist(), return_inverse=True)
                found = _bundles(alphabet, [alphabet.numbers(t) for t in texts], groups)
                for lang, vector in zip(names.tolist(), found.astype(np.float64), strict=True):
                    sums[lang] = sums.get(lang, 0) + vector
        if sums:
            columns = [pa.array(list(sums), pa.string()), pa.array([x for x in sums.values()], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "bundle"])

    return run


def _predicted(shared, gram: int, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = shared.value
        alphabet = Alphabet(gram, dimensions)
        for batch in batches:
            for part, texts in slices(batch, "own_text", SLICE_CHARS):
                numbers = [alphabet.numbers(t or "") for t in texts]
                vectors = _bundles(alphabet, numbers, np.arange(len(numbers)))
                lengths = np.linalg.norm(vectors, axis=1)
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if languages:
                    cosines = (vectors @ prototypes.T) / np.maximum(lengths, 1e-9)[:, None]
                    some = np.array([len(x) > 0 for x in numbers])
                    first = cosines.argmax(axis=1)
                    best = [languages[k] if s else UNKNOWN for k, s in zip(first, some, strict=True)]
                    score = np.where(some, np.clip(cosines.max(axis=1), 0, 1), 0).astype(np.float64)
                columns = [part.column("own_id"), part.column("held_out"), pa.array(best, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, names=["own_id", "held_out", "lang_pred", "score"])

    return run


def predict_languages(
    docs: DataFrame,
    held_out: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    gram: int = GRAM,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """Predicts every text's language from those with a language for which the SQL ``held_out`` is false.

    Each letter has a random vector of -1 and 1; a gram's vector is the product of its letters' vectors, each
    permuted by its place; a text's vector is the sum over its grams. All learning texts of a language are
    bundled into its prototype, and a text gets the language whose prototype has the largest cosine with it
    (the first by name of equals), with the cosine, or 0 if negative, as score. Letters are in lower case; all
    else between them counts as one blank.

    Returns the id column, ``held_out``, ``lang_pred`` and ``score``. Null texts and those without a letter get
    ``und`` and 0, as do all if nothing can be learned. Repeated rows each get a row. Other columns are not read.
    An empty table gives an empty result. The prototypes, one of ``dimensions`` numbers for each language, go
    through the driver.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).alias("own_id"), F.expr(held_out).alias("held_out"), F.col(text_col).alias("own_text"), F.col(lang_col).alias("lang")
    )
    train = own.filter("not held_out and lang is not null and own_text is not null").select("own_text", "lang")
    sums = train.mapInArrow(_language_sums(gram, dimensions), "lang string, bundle array<double>")
    each = sums.select("lang", F.posexplode("bundle").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    rows = each.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v")).orderBy("lang").collect()
    vectors = {r.lang: np.array([x.x for x in r.v]) for r in rows}
    vectors = {lang: v / np.linalg.norm(v) for lang, v in vectors.items() if v.any()}
    shared = spark.sparkContext.broadcast((list(vectors), np.array(list(vectors.values()), np.float32).reshape(-1, dimensions)))
    kinds = [("held_out", T.BooleanType()), ("lang_pred", T.StringType()), ("score", T.DoubleType())]
    found = own.drop("lang").mapInArrow(_predicted(shared, gram, dimensions), fields(own, "own_id", *kinds))
    return found.withColumnRenamed("own_id", id_col)
