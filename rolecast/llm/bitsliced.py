"""Exact top-k by inner product on a bit-sliced index.

Rows are integer vectors. Each dimension is shifted to start at zero and stored as bitmaps:
slice ``b`` of dimension ``d`` has one bit per row. A query adds slices with bitmap
arithmetic only, the most significant first; a dimension with a negative weight adds the
complement. After slices ``B-1 .. s`` a row's score is known up to
``sum(abs(q)) * (2 ** s - 1)``. The k-th best partial sum, found slice by slice from
the top, and that width leave a bitmap of rows that may still be in the result; when it is small, or
all slices are used, the boundary rows are resolved by their exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROW_BLOCK = 32_768
QUERY_BLOCK = 131_072
RESOLVE_ROWS = 1024


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Add bitmaps of given weights (column ``j``: weight ``2 ** j``) into one bitmap per column.

    Carry-save addition: three bitmaps of a column become a sum there and a carry in the next.
    """
    out, j = [], 0
    while columns.get(j) or any(k > j and v for k, v in columns.items()):
        here = [np.atleast_2d(x) for x in columns.get(j, [])]
        if not here:
            out.append(None)
            j += 1
            continue
        stack = np.concatenate(here)
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                a, b, c, rest = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n], stack[3 * n :]
                x = a ^ b
                columns.setdefault(j + 1, []).append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, rest]) if len(rest) else x ^ c
            else:
                columns.setdefault(j + 1, []).append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
        j += 1
    words = next((len(x) for x in out if x is not None), 0)
    return [np.zeros(words, np.uint64) if x is None else x for x in out]


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth_largest(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest number among the rows of a bitmap; -1 if there are fewer."""
    if _count(rows) < k:
        return -1
    value, equal, need = 0, rows, k
    for j in range(len(slices) - 1, -1, -1):
        ones = equal & slices[j]
        n = _count(ones)
        if n >= need:
            equal, value = ones, value | (1 << j)
        else:
            equal, need = equal & ~slices[j], need - n
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, bound: int) -> np.ndarray:
    """Bitmap of the rows whose number is not below ``bound``."""
    if bound <= 0:
        return rows
    if bound >> len(slices):
        return np.zeros_like(rows)
    above, equal = np.zeros_like(rows), rows
    for j in range(len(slices) - 1, -1, -1):
        if bound >> j & 1:
            equal = equal & slices[j]
        else:
            above, equal = above | (equal & slices[j]), equal & ~slices[j]
    return above | equal


class BitSlicedIndex:
    """Bit slices of the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows.astype(np.int64)
        n, dims = self.rows.shape
        words = -(-n // 64)
        self.low = self.rows.min(0) if n else np.zeros(dims, np.int64)
        self.largest = max(abs(int(self.rows.max())), abs(int(self.rows.min()))) if self.rows.size else 0
        shifted = self.rows - self.low
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        padded = np.zeros((dims, words * 64), np.uint8)
        self.slices = np.zeros((self.bits, dims, words), np.uint64)
        for b in range(self.bits):
            padded[:, :n] = (shifted.T >> b) & 1
            self.slices[b] = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        present = np.zeros(words * 64, np.uint8)
        present[:n] = 1
        self.present = np.packbits(present, bitorder="little").view(np.uint64)

    def without(self, own: int) -> np.ndarray:
        """Bitmap of the rows with another id."""
        bits = np.zeros(len(self.present) * 64, np.uint8)
        bits[: len(self.ids)] = self.ids != own
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best other rows, ties to the smaller id."""
        query = query.astype(np.int64)
        weight = np.abs(query)
        if int(weight.astype(object).sum()) * self.largest >= 1 << 62:
            raise OverflowError("scores of such components need more than 64 bits")
        rows, live = self.without(own), np.flatnonzero(weight)
        flip = np.where(query[live] < 0, ~np.uint64(0), np.uint64(0))[:, None]
        # A fixed column of the weights' bits for each slice: which dimensions add at which place.
        masks = [np.flatnonzero(weight[live] >> j & 1) for j in range(int(weight.max(initial=0)).bit_length())]
        total: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            plane = self.slices[b][live] ^ flip
            columns: dict[int, list[np.ndarray]] = {j + 1: [x] for j, x in enumerate(total)}
            for j, members in enumerate(masks):
                if len(members):
                    columns.setdefault(j, []).append(plane[members])
            total = add_slices(columns)
            if b and self.bits - b < 3:
                continue
            best = kth_largest(total, rows, k)
            if best >= 0:
                width = int(weight.sum()) * ((1 << b) - 1)
                rows = at_least(total, rows, best - -(-width // (1 << b)))
            if _count(rows) <= max(RESOLVE_ROWS, k):
                break
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        ids, scores = self.ids[at], self.rows[at] @ query
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; NULL if the vector or a component is NULL or not finite.

    A component beyond what 62 bits hold is an error, as no exact score of it fits a long.
    """
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fitting = lambda x: F.when(F.abs(x) < float(1 << 62), F.floor(x)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))
    return F.when(vector.isNotNull() & ~bad, F.transform(wide, lambda x: fitting(x * scale)))


def top_by_inner_product(
    rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "vector",
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """``(query_id, rank, key, score)``: the k best rows for each query, the query's own key left out.

    ``rows`` and ``queries`` are ``(key, array<long>)``. Rows are dealt by key into blocks of about
    ``row_block``. An index is built once for a block and the queries, up to ``query_block`` of them, stream past it; a task holds
    one index and one batch of queries. A block yields k rows for each query, and Spark
    limits each query to k again before and after the shuffle. Vectors of equal length are compared, each length in blocks of
    its own; NULL vectors and keys take no part; repeated keys are rows of their own. Scores that
    could exceed 64 bits are an error. Empty tables give no rows.
    """
    rows = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("d"), F.monotonically_increasing_id().alias("nr"))
    queries = queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).alias("v"), F.size(vector).alias("d"), F.monotonically_increasing_id().alias("nr"))
    blocks = lambda df, name, most: df.groupBy("d").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    # One row for each length that both sides have.
    grid = F.broadcast(blocks(rows, "rn", row_block).join(blocks(queries, "qn", query_block), "d"))

    def spread(df: DataFrame, own: str, other: str, role: int) -> DataFrame:
        # Repeated keys are dealt by their place too.
        return df.join(grid, "d").select(
            "d", F.pmod(F.xxhash64("id", "nr"), F.col(f"{own}n")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1)).alias(other), F.lit(role).alias("role"), "id", "v"
        )

    both = spread(rows, "r", "q", 0).unionByName(spread(queries, "q", "r", 1))
    laid = both.repartition("d", "r", "q").sortWithinPartitions("d", "r", "q", "role", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        index, current = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1), batch.num_rows]
            ids = batch.column(4).to_numpy()
            for a, b in zip(cuts, cuts[1:]):
                if current != tuple(place[:3, a]):
                    held.clear()
                    index, current = None, tuple(place[:3, a])
                part = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if place[3, a] == 0:
                    held.append((ids[a:b], part))
                    continue
                if held:
                    index = BitSlicedIndex(*(np.concatenate(x) for x in zip(*held)))
                    held.clear()
                if index is None:
                    continue
                for own, query in zip(ids[a:b], part):
                    found, scores = index.top(query, own, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own)), pa.array(found), pa.array(scores)], names=["query_id", key, "score"])

    part = laid.select("d", "r", "q", "role", "id", "v").mapInArrow(search, f"query_id long, {key} long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key)))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
