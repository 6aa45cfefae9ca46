"""Helpers of this subpackage: written tables, text slices, local unions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rolecast.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame, saved in the shared scratch folder and read again.

    Cuts the lineage: what reads it does not depend on the executors that made it.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(column: pa.Array, budget: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of rows with about ``budget`` bytes; a longer row is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield at, to - at
        at = to


def list_array(values: np.ndarray, lengths: list[int] | np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of ``lengths`` values each."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


class Unions:
    """Union-find over the values met in one task."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def root(self, x):
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def join(self, a, b) -> bool:
        """True if they were apart. The smaller root stays."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
