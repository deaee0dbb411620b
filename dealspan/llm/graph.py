"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealspan.llm.common import Scratch

#: So many links, each in both directions, are left to one task: a tail too short for jobs of its own.
TASK_LINKS = 5_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a bounded number of links and the first node of its component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "to"])



def components(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """A label for each node; two nodes have the same label if links lead from one to the other.

    ``nodes`` has distinct ``node`` (long), ``links`` has ``a`` and ``b`` (long). In each round every
    node joins the neighbour, or itself, that comes first in an order drawn anew for the round; the
    links are then carried over to the nodes that are left. Links that lead nowhere new go, so the
    tables shrink by a constant factor a round in expectation. Once at most ``TASK_LINKS`` rows are left, one task
    joins the rest. Returns ``node`` and ``label``.
    """
    both = links.filter("a <> b").select("a", "b").union(links.filter("a <> b").select("b", "a"))
    edges = scratch.keep(both.distinct())
    moves = []
    while edges.count() > TASK_LINKS:
        draw = F.lit(len(moves))
        order = lambda c: F.struct(F.xxhash64(F.col(c), draw), F.col(c).alias("id"))  # noqa: E731, B023
        first = F.least(F.min(order("b")), F.first(order("a")))
        move = scratch.keep(edges.groupBy("a").agg(first["id"].alias("to")))
        moves.append(move)
        to_a, to_b = move.select("a", F.col("to").alias("na")), move.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        edges = scratch.keep(
            edges.join(to_a, "a").join(to_b, "b").filter("na <> nb").select(F.col("na").alias("a"), F.col("nb").alias("b")).distinct()
        )
    moves.append(scratch.keep(edges.repartition(1).mapInArrow(_joined, "a long, to long")))
    out = nodes.select("node", F.col("node").alias("label"))
    for move in moves:
        step = move.select(F.col("a").alias("label"), "to")
        out = out.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return out
