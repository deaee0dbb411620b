"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.common import Scratch, fields, slices
from dealspan.llm.tokens import coder

CAPACITY = 2048
#: A sweep has at least so many ranges; with no more documents left than the other, one task ends the rounds.
RANGES, TAIL = 8, 2_000
#: That task gets at most so many documents and gaps for each document of the tail.
TAIL_ROWS = 8
DOC, GAP, PAIR, MEMBER = 0, 1, 2, 3
STATE = "kind int, id long, size long, gap_id long, gap_size long"


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of ``capacity`` ids and a last, shorter one.

    Returns the id column, ``piece`` (from 0), ``start`` (the document's ids before it), ``length`` and
    ``ids``, little-endian unsigned 32-bit. A null text is empty: one piece with the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = coder(tokenizer), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for part, texts in slices(batch, text_col):
                rows, piece, ids = [], [], []
                for i, text in enumerate(texts):
                    whole = encode(text or "") + end
                    for k, at in enumerate(range(0, len(whole), step)):
                        rows.append(i)
                        piece.append(k)
                        ids.append(whole[at : at + step])
                piece = np.array(piece, np.int32)
                columns = [
                    part.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece),
                    pa.array(piece.astype(np.int64) * capacity),
                    pa.array(np.array([len(x) // 4 for x in ids], np.int64)),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids"])

    more = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType())]
    return docs.select(id_col, text_col).mapInArrow(run, fields(docs, id_col, *more))


def _bundles(least: int):
    """Groups a task's small units in turn until ``least`` ids are together; a group's id is below zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, total = None, 0
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            owner, place = [], []
            for unit, length in zip(ids, lengths, strict=True):
                if first is None:
                    first, total = -1 - unit, 0
                owner.append(first)
                place.append(total)
                total += length
                if total >= least:
                    first = None
            columns = [batch.column(0), batch.column(1), pa.array(owner, pa.int64()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["unit_id", "length", "bundle_id", "place"])

    return run


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sweep up a sorted range: every gap takes the largest document below it that is still free.

    Puts out the pairs, and what is left over with its rank: documents by size from below, gaps in the
    order in which they found none.
    """
    names = ["kind", "id", "size", "gap_id", "gap_size", "rank"]
    kinds = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in names[1:])])
    ids: list[int] = []
    sizes: list[int] = []
    empty = 0
    for batch in batches:
        out = []
        for kind, key, size in zip(*(batch.column(n).to_pylist() for n in ("kind", "id", "size")), strict=True):
            if kind == DOC:
                ids.append(key)
                sizes.append(size)
            elif ids:
                out.append((PAIR, ids.pop(), sizes.pop(), key, size, None))
            else:
                out.append((GAP, None, None, key, size, empty))
                empty += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
    for at in range(0, len(ids), 50_000):
        part = ids[at : at + 50_000]
        none = pa.nulls(len(part), pa.int64())
        ranks = pa.array(range(at, at + len(part)), pa.int64())
        columns = [pa.array([DOC] * len(part), pa.int32()), pa.array(part, pa.int64()), pa.array(sizes[at : at + 50_000], pa.int64()), none, none, ranks]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


def _meet(left: list[tuple[int, int, int]]) -> tuple[list[tuple], list[tuple], int]:
    """Which ranges' left-over documents and gaps meet, from their counts alone.

    ``left`` has (range, documents, gaps) from below. A gap takes the largest free document of the ranges
    below. Returns runs (range, first rank, ranks, number, step) of documents and of gaps; a document and a
    gap with the same number meet. There are at most two runs per range.
    """
    docs, gaps, free, number = [], [], [], 0
    for part, n_docs, n_gaps in left:
        at = 0
        while at < n_gaps and free:
            owner, n = free.pop()
            take = min(n, n_gaps - at)
            gaps.append((part, at, take, number, 1))
            docs.append((owner, n - take, take, number + take - 1, -1))
            number, at = number + take, at + take
            if n > take:
                free.append((owner, n - take))
        if n_docs:
            free.append((part, n_docs))
    return docs, gaps, number


def _opened(n_docs: int, need: int, room: int, halves: int, first: bool, stuck: bool, capacity: int) -> int:
    """How many of the documents that met no gap open a sequence: what their length needs beyond all gaps' room."""
    more = max(0, -((room - need) // capacity))
    if first:
        more = max(more, halves)
    elif stuck:
        more = max(more, 1, -(-need // capacity))
    return min(more, n_docs)


def _rounds(capacity: int):
    """The last rounds, for a few documents and gaps, in one task; it also gets the units of groups that wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int]] = []
        gaps: list[tuple[int, int]] = []
        members: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for kind, key, size, group in zip(*(batch.column(n).to_pylist() for n in ("kind", "id", "size", "group")), strict=True):
                if kind == MEMBER:
                    members.setdefault(group, []).append((size, key))
                else:
                    (docs if kind == DOC else gaps).append((size, key))
        out, smallest = [], min((min(m)[0] for m in members.values()), default=capacity)
        while docs:
            docs.sort()
            gaps.sort()
            free: list[tuple[int, int]] = []
            after: list[tuple[int, int]] = []
            at = met = 0
            for size, gap in gaps:
                while at < len(docs) and docs[at][0] <= size:
                    free.append(docs[at])
                    at += 1
                if free:
                    length, key = free.pop()
                    out.append((key, gap, capacity - size))
                    met += 1
                    size -= length
                if size:
                    after.append((size, gap))
            docs = free + docs[at:]
            need, room = sum(d[0] for d in docs), sum(g[0] for g in after)
            groups = any(key < 0 for _, key in docs)
            n = _opened(len(docs), need, room, 0, False, not met and not groups, capacity)
            for length, key in docs[len(docs) - n :]:
                out.append((key, key, 0))
                if length < capacity:
                    after.append((capacity - length, key))
            docs = docs[: len(docs) - n]
            if groups and not met:
                docs = [unit for size, key in docs for unit in (members[key] if key < 0 else [(size, key)])]
                groups = False
            least = min(docs)[0] if docs else 0
            gaps = [g for g in after if g[0] >= (min(least, smallest) if groups else least)]
        if out:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sequence_id", "offset"])

    return run


def best_fit(units: DataFrame, capacity: int, scratch: Scratch, range_rows: int = 100_000, tail: int = TAIL) -> DataFrame:
    """Places units (``unit_id``, ``length`` up to ``capacity``) in sequences: ``sequence_id``, ``offset``.

    Bulk-synchronous best fit. A first set of sequences is opened by the largest units: as many as their
    total length needs, or as there are units over half the capacity. Then in each round documents and gaps
    are sorted by size over all ranges; each range is swept once, and every gap takes the largest document
    that fits and that no smaller gap has taken. What is left over in a range meets over the ranges by its
    rank, for which the driver sees two counts per range. Gaps shrink, and the round is repeated. Where the
    documents left need more room than all gaps have, or none fits, the largest of them open sequences.
    Units below a 32nd of the capacity are put together first, so that there are few rounds. Groups of them that fit
    no gap do not open sequences for that reason: they fall apart, and their units go on as documents of their own,
    also into gaps smaller than the group. Gaps below all documents are left out. A range has about ``range_rows`` of
    them. Once a round is done and at most ``tail`` documents are left, and not many more gaps, one task does the last rounds by the
    same rules, so that a job for a handful of documents does not follow another. Documents of equal length go by id.
    """
    spark, small = units.sparkSession, max(1, capacity // 32)
    n = max(RANGES, units.count() // range_rows)
    tiny = units.filter(F.col("length") < small)
    grouped = scratch.keep(tiny.repartition(n, "unit_id").mapInArrow(_bundles(small), "unit_id long, length long, bundle_id long, place long"))
    docs = units.filter(F.col("length") >= small).select(F.col("unit_id").alias("id"), F.col("length").alias("size"))
    docs = docs.union(grouped.groupBy("bundle_id").agg(F.sum("length")))
    smallest = grouped.agg(F.min("length")).first()[0]
    members = grouped.select("bundle_id", F.col("unit_id").alias("id"), F.col("length").alias("size"))
    state = docs.select(F.lit(DOC).alias("kind"), "id", "size", F.lit(None).cast("long").alias("gap_id"), F.lit(None).cast("long").alias("gap_size"))
    placed, first, rows = [], True, docs.count()
    waits = rows
    while rows:
        # Below an equal gap, so that a document that fits exactly is met first.
        both = state.select("kind", F.coalesce(F.when(F.col("kind") == GAP, F.col("gap_id")), "id").alias("id"), F.coalesce("gap_size", "size").alias("size"))
        if waits <= tail and rows <= TAIL_ROWS * tail and not first:
            waiting = state.filter(F.col("kind") == DOC).select(F.col("id").alias("bundle_id"))
            parts = members.join(waiting, "bundle_id", "left_semi").select(F.lit(MEMBER).alias("kind"), "id", "size", F.col("bundle_id").alias("group"))
            both = both.withColumn("group", F.lit(None).cast("long")).union(parts)
            placed.append(scratch.keep(both.repartition(1).mapInArrow(_rounds(capacity), "id long, sequence_id long, offset long")))
            break
        n = max(RANGES, rows // range_rows)
        ranges = both.repartitionByRange(n, "size", "kind", "id").sortWithinPartitions("size", "kind", "id")
        swept = scratch.keep(ranges.mapInArrow(_sweep, STATE + ", rank long").withColumn("part", F.spark_partition_id()))
        is_doc, is_gap, is_pair = (F.col("kind") == k for k in (DOC, GAP, PAIR))
        left = swept.groupBy("part").agg(
            F.count_if(is_doc), F.count_if(is_gap), F.count_if(is_pair), F.sum(F.when(is_doc, F.col("size"))),
            F.sum(F.when(is_gap, F.col("gap_size")).when(is_pair, F.col("gap_size") - F.col("size"))),
            F.count_if(is_doc & (F.col("size") * 2 > capacity)), F.count_if(is_doc & (F.col("id") < 0)),
        ).orderBy("part").collect()
        doc_runs, gap_runs, met = _meet([(r[0], r[1], r[2]) for r in left])
        n_docs, need, room = sum(r[1] for r in left), sum(r[4] or 0 for r in left), sum(r[5] or 0 for r in left)
        # Documents that met over the ranges go from both sums alike, so the difference is right.
        any_met = bool(met) or any(r[3] for r in left)
        apart = not first and not any_met and any(r[7] for r in left)
        opened = _opened(n_docs - met, need, room, sum(r[6] for r in left), first, not any_met and not apart, capacity)
        # The largest documents that met no gap.
        taken = {part: at for part, at, *_ in sorted(doc_runs, reverse=True)}
        new_runs, wanted = [], opened
        for part, count, *_ in reversed(left):
            if (free := min(wanted, taken.get(part, count))) > 0:
                new_runs.append((part, taken.get(part, count) - free, free, 0, 0))
                wanted -= free
        runs = [(DOC, *r) for r in doc_runs] + [(GAP, *r) for r in gap_runs] + [(PAIR, *r) for r in new_runs]
        run = spark.createDataFrame(runs, "what int, part int, first long, ranks long, number long, step int")
        inside = lambda what: F.broadcast(run.filter(F.col("what") == what).drop("what"))  # noqa: E731  at most 4 rows per range
        number = (F.col("number") + F.col("step") * (F.col("rank") - F.col("first"))).alias("number")
        within = F.col("rank").between(F.col("first"), F.col("first") + F.col("ranks") - 1)
        here = lambda kind, what: swept.filter(F.col("kind") == kind).join(inside(what).withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & within, "left")
        met_docs = here(DOC, DOC).select("id", "size", "rank", "part", number)
        new = inside(PAIR).select(F.col("part").alias("p"), F.col("first").alias("f"), F.col("ranks").alias("m"))
        is_new = (F.col("part") == F.col("p")) & F.col("rank").between(F.col("f"), F.col("f") + F.col("m") - 1)
        lone = met_docs.filter("number is null").join(new, is_new, "left")
        none = F.lit(None).cast("long")
        lone = lone.select(
            F.when(F.col("p").isNull(), DOC).otherwise(PAIR).alias("kind"), "id", "size",
            F.when(F.col("p").isNotNull(), F.col("id")).alias("gap_id"), F.when(F.col("p").isNotNull(), F.lit(capacity).cast("long")).alias("gap_size"),
        )
        gaps = here(GAP, GAP).select("gap_id", "gap_size", number)
        met_pairs = met_docs.filter("number is not null").select("number", "id", "size").join(gaps.filter("number is not null"), "number")
        rest = gaps.filter("number is null").select(F.lit(GAP).alias("kind"), none.alias("id"), none.alias("size"), "gap_id", "gap_size")
        pairs = swept.filter(is_pair).select("kind", "id", "size", "gap_id", "gap_size")
        after = [pairs, lone, rest]
        if met:
            after.append(met_pairs.select(F.lit(PAIR).alias("kind"), "id", "size", "gap_id", "gap_size"))
        step = after[0]
        for x in after[1:]:
            step = step.union(x)
        step = scratch.keep(step)
        put = step.filter(is_pair)
        placed.append(put.select("id", F.col("gap_id").alias("sequence_id"), (F.lit(capacity) - F.col("gap_size")).alias("offset")))
        shrunk = put.select(F.lit(GAP).alias("kind"), none.alias("id"), none.alias("size"), "gap_id", (F.col("gap_size") - F.col("size")).alias("gap_size"))
        waiting = step.filter(is_doc)
        if apart:
            fell = members.join(waiting.select(F.col("id").alias("bundle_id")), "bundle_id", "left_semi")
            fell = fell.select(F.lit(DOC).alias("kind"), "id", "size", none.alias("gap_id"), none.alias("gap_size"))
            waiting = scratch.keep(waiting.filter("id >= 0").union(fell))
        least, first_id, waits = waiting.agg(F.min("size"), F.min("id"), F.count("*")).first()
        if least is None:
            break
        if first_id < 0:
            least = min(least, smallest)
        state = waiting.union(step.filter(is_gap).union(shrunk).filter(F.col("gap_size") >= least))
        rows, first = state.count(), False
    empty = spark.createDataFrame([], "id long, sequence_id long, offset long")
    for x in placed:
        empty = empty.union(x)
    whole = scratch.keep(empty)
    singles = units.select(F.col("unit_id").alias("id"), "unit_id", F.lit(0).cast("long").alias("place"))
    found = singles.union(grouped.select(F.col("bundle_id").alias("id"), "unit_id", "place"))
    return found.join(whole, "id").select("unit_id", "sequence_id", (F.col("offset") + F.col("place")).alias("offset"))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All documents' pieces with their place in sequences of at most ``capacity`` ids.

    Returns the id column, ``piece``, ``start``, ``length``, the columns of ``carry`` (expressions on those
    and on ``ids``; by default ``ids`` themselves), ``sequence_id`` and ``offset``. Only documents longer
    than ``capacity`` are cut. Pieces of a sequence follow each other without gaps from 0. Null and empty
    texts are one end id. Repeated rows are packed each. Other columns are not read, so they may have any
    names. An empty table gives an empty result.
    """
    carry = {"ids": F.col("ids")} if carry is None else carry
    with Scratch(docs.sparkSession) as scratch:
        pieces = token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
        own = [F.col(id_col).alias("own_id"), "piece", "start", "length"]
        pieces = pieces.select(*own, *(c.alias(f"carry_{n}") for n, c in carry.items()))
        pieces = scratch.keep(pieces.withColumn("unit_id", F.monotonically_increasing_id()))
        cut = pieces.filter(F.col("length") < capacity).select("unit_id", "length")
        places = best_fit(cut, capacity, scratch)
        full = pieces.filter(F.col("length") == capacity).select("*", F.col("unit_id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        out = pieces.filter(F.col("length") < capacity).join(places, "unit_id").select(full.columns).union(full)
        names = [F.col(f"carry_{n}").alias(n) for n in carry]
        return scratch.result(out.select(F.col("own_id").alias(id_col), "piece", "start", "length", *names, "sequence_id", "offset"))
