"""Ranked lexical search over a frequency-ordered document tree.

Each document is restricted to the terms that are asked for, most frequent first, and documents with
equal beginnings share a path of a tree. Every node keeps the largest count of each term and the least
length norm below it; both together bound the score of all documents below, for every item at
once. The tree is searched depth first, likely branches first, and a branch is left when
no item can find one of its best documents there. What is left out is lower than the results, so they
are exact.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecast.llm.common import list_array, written

#: A term is a run of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_ITEMS, BLOCK_CELLS, BLOCK_SIGNS = 512, 1 << 21, 8 << 20
TREE_POSTINGS, TREE_DOCUMENTS = 1 << 21, 1 << 14
LANES = 64
_LAST = 1 << 63  # place of documents without an id: behind all others


def terms_of(text: str | None) -> list[str]:
    """The terms of a text; only A to Z are lower-cased."""
    return _FIND(pc.ascii_lower(pa.scalar(text)).as_py()) if text else []


_FIND = re.compile(TERM).findall


def weight(n_documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * df + 1)))


def parts_of_score(tf: np.ndarray, norm) -> np.ndarray:
    """A term's share of a score before its weight: grows with the count, falls with the norm."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


@dataclass(frozen=True)
class Asked:
    """A block of items: names, and the weight of each term (by frequency rank) for each item."""

    items: list
    weights: np.ndarray  # terms x items


class Node:
    __slots__ = ("terms", "most", "norm", "children", "documents")

    def __init__(self, terms, most, norm, children, documents) -> None:
        self.terms, self.most, self.norm, self.children, self.documents = terms, most, norm, children, documents


def build_tree(vectors: list[tuple[bytes, bytes, int, list[int]]]) -> Node | None:
    """The tree of ``(terms, counts, norm, ids)`` rows, each different from the others.

    ``terms`` are ascending frequency ranks as big-endian 32-bit integers, so that bytes sort
    like the lists they stand for; ``counts`` are little-endian 64-bit integers.
    """
    rows = sorted(vectors)
    if not rows:
        return None

    def shared(lo: int, hi: int) -> int:
        a, b = rows[lo][0], rows[hi - 1][0]
        n = min(len(a), len(b)) // 4
        for k in range(n):
            if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4]:
                return k
        return n

    def leaf(k: int) -> Node:
        terms, counts, norm, ids = rows[k]
        return Node(np.frombuffer(terms, ">u4").astype(np.int64), np.frombuffer(counts, "<i8"), norm, None, ids)

    def joined(children: list[Node]) -> Node:
        if len(children) == 1:
            return children[0]
        terms = np.concatenate([c.terms for c in children])
        order = np.argsort(terms, kind="stable")
        terms, most = terms[order], np.concatenate([c.most for c in children])[order]
        begin = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        return Node(terms[begin], np.maximum.reduceat(most, begin), min(c.norm for c in children), children, None)

    # Depth first with a stack of its own: a path is as long as the largest document.
    done: dict[tuple[int, int, int], Node] = {}
    stack = [(0, len(rows), 0)]
    while stack:
        key = stack[-1]
        lo, hi, depth = key
        if hi - lo == 1:
            done[key] = leaf(lo)
            stack.pop()
            continue
        depth = max(depth, shared(lo, hi))
        parts, at = [], lo
        while at < hi:
            head = rows[at][0][4 * depth : 4 * depth + 4]
            to = at + 1
            while to < hi and rows[to][0][4 * depth : 4 * depth + 4] == head:
                to += 1
            # Documents that end here differ in counts or norm only: each is a leaf.
            parts += [(at, to, depth + 1)] if head else [(k, k + 1, depth) for k in range(at, to)]
            at = to
        missing = [p for p in parts if p not in done]
        if missing:
            stack += missing
            continue
        done[key] = joined([done.pop(p) for p in parts])
        stack.pop()
    return done[0, len(rows), 0]


class Search:
    """Best documents of each item over any number of trees."""

    def __init__(self, asked: Asked, top: int) -> None:
        self.asked, self.top = asked, top
        # Whole numbers below 2^53 stay exact in doubles, whose products are much faster.
        exact = not asked.weights.size or float(asked.weights.sum(axis=0).max()) * 1_000_000 < 2**53
        self.weights = asked.weights.astype(np.float64 if exact else np.int64)
        self.best: list[list[tuple[int, int]]] = [[] for _ in asked.items]
        self.least = np.ones(len(asked.items), self.weights.dtype)  # a score must be above 0
        self.visited = self.left = 0

    def bound(self, node: Node) -> np.ndarray:
        """For each item, what no document below exceeds; the score itself at a leaf."""
        return parts_of_score(node.most, node.norm).astype(self.weights.dtype) @ self.weights[node.terms]

    def put(self, scores: np.ndarray, ids: list[int]) -> None:
        for k in np.flatnonzero(scores >= self.least):
            found, score = self.best[k], int(scores[k])
            for i in ids:
                if len(found) < self.top:
                    heapq.heappush(found, (score, -i))
                else:
                    heapq.heappushpop(found, (score, -i))
            if len(found) == self.top:
                self.least[k] = found[0][0]

    def add(self, root: Node | None) -> None:
        stack = [(root, self.bound(root))] if root is not None else []
        while stack:
            node, bound = stack.pop()
            if not (bound >= self.least).any():
                self.left += 1
                continue
            self.visited += 1
            if node.children is None:
                self.put(bound, node.documents)
                continue
            below = []
            for child in node.children:
                bound = self.bound(child)
                if child.children is None:
                    self.put(bound, child.documents)
                else:
                    below.append((child, bound))
            below.sort(key=lambda x: (x[1] - self.least).max())
            stack += below  # the most promising one is taken first

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for k, found in enumerate(self.best):
            for score, i in found:
                yield k, None if -i == _LAST else -i, score


def restricted(docs: DataFrame, vocabulary: dict[str, int], key: str, text: str) -> DataFrame:
    """``(key, n, terms, counts)`` of each document with a term: all its terms counted in ``n``, those in the vocabulary one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            rows, n, terms, counts, lengths = [], [], [], [], []

            def made() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), list_array(np.array(terms, np.int32), lengths, pa.int32()), list_array(np.array(counts, np.int64), lengths, pa.int64())]
                return pa.RecordBatch.from_arrays(columns, names=["doc", "n", "terms", "counts"])

            for k in range(batch.num_rows):
                found = terms_of(batch.column(1)[k].as_py())
                if not found:
                    continue
                tf = Counter(map(number, found))
                tf.pop(None, None)
                rows.append(k)
                n.append(len(found))
                terms += tf
                counts += tf.values()
                lengths.append(len(tf))
                if len(terms) > 1 << 20:
                    yield made()
                    rows, n, terms, counts, lengths = [], [], [], [], []
            yield made()

    return docs.select(F.col(key).cast("long").alias("doc"), text).mapInArrow(run, "doc long, n long, terms array<int>, counts array<long>")


def _search(vectors: DataFrame, rank: np.ndarray, asked: Asked, top: int) -> DataFrame:
    """``(item, doc, score, lane)``: the best rows of each task. ``rank`` orders the terms, most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        search = Search(asked, top)
        held: dict[tuple[bytes, bytes, int], list[int]] = {}
        size = documents = 0

        def grow() -> None:
            # Documents alike in everything have equal scores, so the first of them are enough.
            search.add(build_tree([(*alike, ids) for alike, ids in held.items()]))
            held.clear()

        for batch in batches:
            begin = batch.column(2).offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            terms, counts = (batch.column(k).values.to_numpy(zero_copy_only=False)[begin[0] : begin[-1]] for k in (2, 3))
            begin -= begin[0]
            terms = rank[terms]
            order = np.lexsort((terms, np.repeat(np.arange(batch.num_rows), np.diff(begin))))
            terms, counts = terms[order], counts[order]
            for k, (doc, norm) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                a, b = begin[k], begin[k + 1]
                ids = held.setdefault((terms[a:b].astype(">u4").tobytes(), counts[a:b].astype("<i8").tobytes(), norm), [])
                heapq.heappush(ids, _LAST if doc is None else doc)
                if len(ids) > 4 * top:
                    ids[:] = heapq.nsmallest(top, ids)
                size, documents = size + int(b - a), documents + 1
                if size > TREE_POSTINGS or documents > TREE_DOCUMENTS:
                    grow()
                    size = documents = 0
        grow()
        rows = list(search.rows())
        lane = TaskContext.get().partitionId() % LANES
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns], pa.array([lane] * len(rows), pa.int32())], names=["item", "doc", "score", "lane"]
        )

    return vectors.select("doc", "norm", "terms", "counts").mapInArrow(run, "item long, doc long, score long, lane int")


def best_per(rows: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items with their counted terms, a bounded block at a time; items without terms are left out."""
    block, vocabulary, signs = [], set(), 0
    for item, text in items.toLocalIterator():
        terms = Counter(terms_of(text))
        if not terms:
            continue
        wide = len(vocabulary | terms.keys()) * (len(block) + 1)
        if block and (len(block) >= BLOCK_ITEMS or wide > BLOCK_CELLS or signs + len(text) > BLOCK_SIGNS):
            yield block
            block, vocabulary, signs = [], set(), 0
        block.append((item, terms))
        vocabulary |= terms.keys()
        signs += len(text)
    if block:
        yield block


def rank_documents(
    docs: DataFrame, items: DataFrame, top: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(item, rank, key, score)``: the ``top`` best documents of each item with a score above 0.

    Counts and lengths are of all documents. Equal scores go by ascending key, NULL keys last. Items come to the driver a
    block at a time (512 items, 2 million term-item cells or 8 MB of text), and the
    documents are read once for each block. NULL, empty and term-less texts find nothing and are not found; a repeated document is a
    document of its own; equal ``(item, text)`` rows are one item, and different texts of one item are ranked each by itself. An empty table gives no rows; other columns are ignored. Keys are whole numbers. A task holds
    one tree of at most 2 million postings; a longer document is a tree of its own.
    """
    spark = docs.sparkSession
    asked_rows = items.select(F.col(item).alias("item"), F.col(item_text).alias("t")).where("t is not null").distinct()
    kind = asked_rows.schema["item"].dataType.simpleString()
    out = None
    for block in _blocks(asked_rows):
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*[terms for _, terms in block])))}
        vectors = written(restricted(docs, vocabulary, key, text), "term-vectors")
        n_documents, length = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_documents:
            break
        # One row for each term of the block.
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        by_frequency = sorted(vocabulary.values(), key=lambda t: (-df.get(t, 0), t))
        rank = np.empty(len(by_frequency), np.int64)
        rank[by_frequency] = np.arange(len(by_frequency))
        weights = np.zeros((len(vocabulary), len(block)), np.int64)
        for column, (_, terms) in enumerate(block):
            for term, times in terms.items():
                t = vocabulary[term]
                weights[rank[t], column] = times * weight(n_documents, df.get(t, 0))
        asked = Asked([name for name, _ in block], weights)
        norm = F.lit(25) + F.expr(f"(75L * n * {n_documents}L) div {length}L")
        found = _search(vectors.where("size(terms) > 0").withColumn("norm", norm), rank, asked, top)
        # First within lanes of tasks, then for each item: no task meets the rows of all tasks.
        found = best_per(best_per(found, ["item", "lane"], top).drop("rank"), ["item"], top)
        names = spark.createDataFrame(list(enumerate(asked.items)), f"item long, name {kind}").coalesce(1)
        found = found.join(F.broadcast(names), "item").select(F.col("name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(key), "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"{item} {kind}, rank int, {key} long, score long") if out is None else out
