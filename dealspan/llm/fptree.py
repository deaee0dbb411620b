"""Ranked lexical search: documents in prefix trees of their frequency-ordered terms, searched by branch and bound."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealspan.llm.arrays import lists, ranges, runs
from dealspan.llm.common import Scratch, ascii_lower, fields, slices

#: Letters and digits of ASCII and all characters beyond it make up terms.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: So many terms of items are searched for at once; more items go in further blocks.
BLOCK_TERMS = 200_000
#: Documents in one tree, their terms at most, documents that are scored together.
TREE_DOCS, TREE_CELLS, LEAF_DOCS = 4096, 2_000_000, 64
#: Products of cells and documents that are held at once.
STEP = 2_000_000


def item_terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _vectors(number: dict[bytes, int]) -> Callable:
    """Each document's number of terms, and its counts of the terms asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, get = pa.list_(pa.int32()), number.get
        for batch in batches:
            for part, texts in slices(batch, "own_text"):
                n, terms, counts = [], [], []
                for text in texts:
                    words = text.encode().translate(_BYTES).split() if text else []
                    own = [(t, c) for w, c in Counter(words).items() if (t := get(w)) is not None]
                    n.append(len(words))
                    terms.append([t for t, _ in own])
                    counts.append([c for _, c in own])
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(terms, kind), pa.array(counts, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=["own_id", "n", "terms", "counts"])

    return run


class Queries:
    """The items of a block: for each the ranks and weights of its terms, one behind the other."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray) -> None:
        self.size = np.array([len(t) for t in terms], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.rank = np.concatenate(terms)
        self.weight = weights[self.rank]
        self.n_ranks = len(weights)

    def cells(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the items' terms, and where each item's begin among them."""
        size = self.size[items]
        return ranges(self.begin[items], size), np.cumsum(size) - size


def gains(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """The part of a term's weight that a document earns, in millionths."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """Documents by their terms in order of falling frequency; equal beginnings share a path.

    A node stands for the documents ``lo`` to ``hi`` below a path. It knows the terms in its subtree, each with the
    largest tf there, and the smallest m. Paths without a fork are one node. Up to ``leaf`` documents, or any number with
    equal terms, are a leaf; small neighbours under one node share a leaf.
    """

    def __init__(self, ranks: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, leaf: int = LEAF_DOCS) -> None:
        keys = [r.astype(">u4").tobytes() for r in ranks]
        self.order = np.array(sorted(range(len(ranks)), key=keys.__getitem__), np.int64)
        self.m = m[self.order]
        self.ranks = [ranks[i] for i in self.order]
        self.size = np.array([len(r) for r in self.ranks], np.int64)
        self.end = np.cumsum(self.size)
        self.rank = np.concatenate(self.ranks)
        self.tf = np.concatenate([tfs[i] for i in self.order]).astype(np.int64)
        self.span: list[tuple[int, int]] = []
        self.below: list[list[int]] = []
        self._grow(leaf)
        self.most: list[tuple[np.ndarray, np.ndarray]] = [()] * len(self.span)
        self.least_m = np.zeros(len(self.span), np.int64)
        for node in reversed(range(len(self.span))):  # children come after their parents
            lo, hi = self.span[node]
            if self.below[node]:
                rank, tf = (np.concatenate(x) for x in zip(*(self.most[c] for c in self.below[node]), strict=True))
            else:
                rank, tf, _ = self.cells(lo, hi)
            by = np.argsort(rank, kind="stable")
            rank, tf = rank[by], tf[by]
            new = runs(rank)
            self.most[node] = rank[new], np.maximum.reduceat(tf, new)
            self.least_m[node] = self.m[lo:hi].min()

    def cells(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks, tfs and documents (from ``lo``) of all terms of some documents."""
        a, b = self.end[lo] - self.size[lo], self.end[hi - 1]
        return self.rank[a:b], self.tf[a:b], np.repeat(np.arange(hi - lo), self.size[lo:hi])

    def _node(self, lo: int, hi: int) -> int:
        self.span.append((lo, hi))
        self.below.append([])
        return len(self.span) - 1

    def _grow(self, leaf: int) -> None:
        open_nodes = [(self._node(0, len(self.ranks)), 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            lo, hi = self.span[node]
            first, last = self.ranks[lo], self.ranks[hi - 1]
            if hi - lo <= leaf or np.array_equal(first, last):  # in order, so all between them are equal too
                continue
            short = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:short] != last[depth:short])
            depth = depth + int(differ[0]) if len(differ) else short
            here = np.array([r[depth] if len(r) > depth else -1 for r in self.ranks[lo:hi]])
            edges = [*(runs(here) + lo), hi]
            begin = lo
            for a, b, after in zip(edges[:-1], edges[1:], [*edges[2:], None], strict=True):
                # neighbours that together stay small share a leaf
                if after is not None and after - begin <= leaf:
                    continue
                child = self._node(begin, b)
                self.below[node].append(child)
                if begin == a:
                    open_nodes.append((child, depth))
                begin = b


class Best:
    """The best ``k`` documents of each item so far."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # a score must be above 0

    def add(self, item: int, scored: list[tuple]) -> None:
        """Takes (-score, id is null, id) on."""
        self.found[item] = sorted([*self.found[item], *scored], key=lambda x: (x[0], x[1], 0 if x[1] else x[2]))[: self.k]
        if len(self.found[item]) == self.k:
            self.least[item] = -self.found[item][-1][0]


def search(tree: Tree, ids: list, queries: Queries, best: Best) -> int:
    """Depth first, children of larger bound first; a subtree is left out for an item whose bound is under its k-th score.

    The bound is the score of a document with the subtree's largest tf of each term and its smallest m, so no document
    in it scores more; equal scores are looked at, because the smaller id goes first. Returns the number of documents scored.
    """
    tf_of, row_of = np.zeros(queries.n_ranks, np.int64), np.full(queries.n_ranks, -1, np.int64)

    def bounds(node: int, items: np.ndarray) -> np.ndarray:
        rank, tf = tree.most[node]
        cells, begin = queries.cells(items)
        tf_of[rank] = tf
        upper = np.add.reduceat(queries.weight[cells] * gains(tf_of[queries.rank[cells]], tree.least_m[node]), begin)
        tf_of[rank] = 0
        return upper

    def score(node: int, items: np.ndarray) -> int:
        lo, hi = tree.span[node]
        own, _ = tree.most[node]
        row_of[own] = np.arange(len(own))
        cells, _ = queries.cells(items)
        rows, item = row_of[queries.rank[cells]], np.repeat(items, queries.size[items])
        here = rows >= 0
        rows, item, weight = rows[here], item[here], queries.weight[cells][here]
        row_of[own] = -1
        if not len(rows):
            return 0
        new = runs(item)
        step = max(1, STEP // max(len(rows), len(own)))
        for a in range(lo, hi, step):
            b = min(a + step, hi)
            rank, tf, doc = tree.cells(a, b)
            table = np.zeros((len(own), b - a), np.int64)
            table[np.searchsorted(own, rank), doc] = tf
            table = gains(table, tree.m[a:b])
            scores = np.add.reduceat(table[rows] * weight[:, None], new, axis=0)
            hits, docs = np.nonzero(scores >= best.least[item[new]][:, None])
            for x in runs(hits):
                q = hits[x]
                at = docs[x : np.searchsorted(hits, q, "right")]
                if len(at) > best.k:  # ties at the end stay: their ids decide
                    at = at[scores[q, at] >= np.partition(scores[q, at], -best.k)[-best.k]]
                own_ids = [ids[i] for i in tree.order[a + at]]
                best.add(int(item[new[q]]), [(-int(s), i is None, i) for s, i in zip(scores[q, at], own_ids, strict=True)])
        return hi - lo

    everyone = np.flatnonzero(queries.size)
    stack, scored = [(0, everyone, bounds(0, everyone))], 0
    while stack:
        node, items, upper = stack.pop()
        items = items[upper >= best.least[items]]
        if not len(items):
            continue
        if not tree.below[node]:
            scored += score(node, items)
            continue
        children = [(child, items, bounds(child, items)) for child in tree.below[node]]
        stack += sorted(children, key=lambda c: int(c[2].max()))
    return scored


def _searched(queries: Queries, item_no: np.ndarray, rank_of: np.ndarray, n_docs: int, n_terms: int, k: int, tree_docs: int, leaf: int) -> Callable:
    """Every item's best documents of a task's partition, from one tree after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(len(queries.size), k), None
        ids: list = []
        ranks: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        sizes: list[int] = []
        cells = 0

        def finish() -> None:
            m = 100 - 90 + 90 * np.array(sizes, np.int64) * n_docs // n_terms
            search(Tree(ranks, tfs, m, leaf), ids, queries, best)
            for x in (ids, ranks, tfs, sizes):
                x.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            all_ids, all_sizes = batch.column(0), batch.column(1).to_numpy()
            for i, (terms, counts) in enumerate(zip(lists(batch.column(2)), lists(batch.column(3)), strict=True)):
                if not len(terms):
                    continue
                own = rank_of[terms]
                by = np.argsort(own)
                ids.append(all_ids[i].as_py())
                ranks.append(own[by])
                tfs.append(counts[by])
                sizes.append(int(all_sizes[i]))
                cells += len(own)
                if len(ids) >= tree_docs or cells >= TREE_CELLS:
                    finish()
                    cells = 0
        if ids:
            finish()
        rows = [(item_no[item], i, -s) for item, found in enumerate(best.found) for s, _, i in found]
        if rows:
            item, own, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(item, pa.int64()), pa.array(scores, pa.int64())], names=["own_id", "item_no", "score"])

    return run


def _blocks(asked: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items in runs with ``most`` terms together, or of one item with more."""
    block, n = [], 0
    for row in asked.select("item_no", "terms").toLocalIterator():
        if block and n + len(row.terms) > most:
            yield block
            block, n = [], 0
        block.append((row.item_no, row.terms))
        n += len(row.terms)
    if block:
        yield block


def best_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_terms: int = BLOCK_TERMS,
    tree_docs: int = TREE_DOCS,
    leaf_docs: int = LEAF_DOCS,
) -> DataFrame:
    """The ``k`` documents with the highest score above 0 for each item: item, ``rank`` (from 1), id, ``score``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N documents that have terms,
    L terms in all, n in a document, df documents with a term, tf of it in a document: m = 10 + 90*n*N div L, a term's weight
    w = floor(1000*ln((2N+2)/(2df+1))), and the score is the sum of w * (10^9*tf div (1000*tf + 8*m)) over the item's distinct terms.

    The items are the stated queries and go in blocks of at most ``block_terms`` terms, or of one longer item; only a block's terms are
    sent to the tasks. Each document becomes a vector of the block's terms, ordered by falling frequency. A task puts ``tree_docs`` vectors at a time
    into a prefix tree whose nodes bound their subtree by its largest tfs and smallest m, and searches it depth first for all items, each
    with its own threshold, which it keeps from tree to tree. Texts are not shuffled. The tasks' best are ranked at the end.

    Equal scores go by smaller id, null ids last; equal rows are documents of their own. A null or empty text has no terms and is
    not found. Rows with the same item id, null included, are one item with the terms of all of them; items without terms have no rows.
    Other columns are not read. Empty tables give an empty result. A very long text is one vector, no longer than the block's terms.
    """
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    with Scratch(docs.sparkSession) as scratch:
        words = items.select(F.col(item_col).alias("item_id"), F.explode_outer(item_terms(F.col(item_text_col))).alias("term"))
        asked = words.groupBy("item_id").agg(F.collect_set("term").alias("terms")).filter("size(terms) > 0")
        asked = scratch.keep(asked.withColumn("item_no", F.monotonically_increasing_id()))
        ints = T.ArrayType(T.IntegerType())
        kind = fields(own, "own_id", ("n", T.LongType()), ("terms", ints), ("counts", ints))
        out = fields(own, "own_id", ("item_no", T.LongType()), ("score", T.LongType()))
        found = docs.sparkSession.createDataFrame([], out)
        for block in _blocks(asked, block_terms):
            number = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
            vectors = scratch.keep(own.mapInArrow(_vectors({t.encode(): i for t, i in number.items()}), kind))
            n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            df = np.zeros(len(number), np.int64)
            for row in vectors.select(F.explode_outer("terms").alias("t")).groupBy("t").count().filter("t is not null").collect():  # at most the block's terms
                df[row.t] = row["count"]
            by_df = np.argsort(-df, kind="stable")
            rank_of = np.empty(len(number), np.int64)
            rank_of[by_df] = np.arange(len(number))
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df[by_df]], np.int64)
            queries = Queries([rank_of[[number[t] for t in terms]] for _, terms in block], weights)
            item_no = np.array([i for i, _ in block], np.int64)
            run = _searched(queries, item_no, rank_of, n_docs, n_terms, k, tree_docs, leaf_docs)
            found = found.union(scratch.keep(vectors.mapInArrow(run, out)))
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("own_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked = ranked.join(asked.select("item_no", "item_id"), "item_no")
        return scratch.result(ranked.select(F.col("item_id").alias(item_col), "rank", F.col("own_id").alias(id_col), "score"))
