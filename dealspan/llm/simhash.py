"""Near duplicates by SimHash: a search of all fingerprints within a few bits of each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields
from dealspan.llm.graph import components

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a text's word shingles: a bit is set if it is in over half of their hashes."""
    ws = (text or "").encode().lower().split()  # of bytes: A-Z only, ASCII blanks only
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(ws) - shingle + 1].tolist()
    hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Each row's id and ``fp``, its 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, fields(docs, id_col, ("fp", T.LongType())))


def ball_plan(max_bits: int, segments: int) -> list[tuple[int, int, list[int]]]:
    """Per segment its number, its mask, and the changes to try on it.

    If two fingerprints differ in at most ``max_bits = segments * r + rest`` bits, then either one of the
    first ``rest + 1`` segments differs in at most ``r`` bits, or one of the others in at most ``r - 1``:
    else they would differ in more bits altogether.
    """
    r, rest = divmod(max_bits, segments)
    cuts = [BITS * i // segments for i in range(segments + 1)]
    plan = []
    for s in range(segments):
        radius = r if s <= rest else r - 1
        at = range(cuts[s], cuts[s + 1])
        changes = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(at, k)]
        if changes:
            plan.append((s, sum(1 << i for i in at), changes))
    return plan


def cheapest_segments(texts: int, max_bits: int) -> int:
    """The number of segments, up to one more than ``max_bits``, with the fewest rows met by each look-up of ``texts`` fingerprints."""

    def rows_met(segments: int) -> float:
        plan = ball_plan(max_bits, segments)
        return sum(len(changes) * (1 + texts / 2.0 ** mask.bit_count()) for _, mask, changes in plan)

    return min(range(min(2, max_bits + 1), max_bits + 2), key=rows_met)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _probes(fp: Column, plan: list[tuple[int, int, list[int]]], balls: bool) -> Column:
    rows = []
    for s, mask, changes in plan:
        whole = fp.bitwiseAND(F.lit(_signed(mask)))
        for change in changes if balls else [0]:
            rows.append(F.struct(F.lit(s).alias("seg"), whole.bitwiseXOR(F.lit(_signed(change))).alias("key")))
    return F.explode(F.array(*rows))


def near_links(fps: DataFrame, max_bits: int, segments: int) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits.

    Multi-index hashing: one table per segment of the fingerprint. Every fingerprint looks up the keys
    in a small Hamming ball around each of its segments; the matches' whole distance decides. The
    distance is checked inside the join, so only true links are put out, some of them once for each of
    several segments. ``cheapest_segments`` chooses their number by the number of texts: few short look-ups
    for few texts, larger balls around longer keys for very many.
    """
    plan = ball_plan(max_bits, segments)
    probes = fps.select(F.col("fp").alias("a"), _probes(F.col("fp"), plan, True).alias("p")).select("a", "p.*")
    table = fps.select(F.col("fp").alias("b"), _probes(F.col("fp"), plan, False).alias("p")).select("b", "p.*")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return probes.join(table, ["seg", "key"]).filter((F.col("a") < F.col("b")) & close).select("a", "b")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    segments: int | None = None,
) -> DataFrame:
    """Each row's id, ``fp`` and ``component_id``, the smallest id that links lead to.

    Equal fingerprints, so all exact copies, are one node of the search, however many rows have them.
    Null and blank texts have fingerprint zero and link like any other. Repeated rows each get a row. A
    null id gets the group's smallest id that is not null, or null if there is none. Only the id and text
    columns are read, so others may have any names. An empty table gives an empty result. The number of
    ``segments`` follows from the number of distinct fingerprints where none is given; it does not change the links.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(fingerprints(docs, id_col, text_col, shingle).toDF("own_id", "fp"))
        texts = scratch.keep(found.groupBy("fp").agg(F.min("own_id").alias("least")))
        links = near_links(texts.select("fp"), max_bits, segments or cheapest_segments(texts.count(), max_bits))
        labels = components(texts.select(F.col("fp").alias("node")), links, scratch)
        labels = scratch.keep(labels.join(texts, F.col("node") == F.col("fp")).select("fp", "label", "least"))
        least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
        by_text = labels.join(least, "label").select("fp", "component_id")
        return scratch.result(found.join(by_text, "fp").select(F.col("own_id").alias(id_col), "fp", "component_id"))


def hex_digits(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
