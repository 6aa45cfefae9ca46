"""Text to unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT

Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Bag of words hashed into ``dims`` counts, as a unit vector.

    The default encoder, since no model weights can be assumed. Any callable
    from a list of texts to a matrix can replace it.
    """

    def __init__(self, dims: int = 256) -> None:
        self.dims = dims
        self._bucket: dict[str, int] = {}

    def _of(self, word: str) -> int:
        bucket = self._bucket.get(word)
        if bucket is None:
            bucket = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims
            if len(self._bucket) < 1_000_000:
                self._bucket[word] = bucket
        return bucket

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            buckets = [self._of(w) for w in text.split()]
            if buckets:
                out[row] = np.bincount(buckets, minlength=self.dims)
        return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def batch_embed(
    texts: DataFrame,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    key: str = "candidate_id",
    text_column: str = "text",
    batch_size: int = DEFAULT.retrieval.batch_size,
) -> DataFrame:
    """``(key, embedding)`` with one unit vector per row.

    ``make_encoder`` is called once per task; texts go to it in batches.
    """
    kind = texts.select(key).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, batch_size):
                chunk = [t or "" for t in column.slice(at, batch_size).to_pylist()]
                vectors = unit_rows(np.asarray(encoder(chunk), dtype=np.float64))
                flat = pa.array(vectors.astype(np.float32).ravel())
                offsets = pa.array(np.arange(len(chunk) + 1, dtype=np.int32) * vectors.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, batch_size), pa.ListArray.from_arrays(offsets, flat)],
                    names=[key, "embedding"],
                )

    return texts.select(key, text_column).mapInArrow(encode, f"{key} {kind}, embedding array<float>")


def l2_normalise(vector: Column) -> Column:
    """A vector scaled to length one; a zero vector becomes NULLs."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.try_divide(x, length))
