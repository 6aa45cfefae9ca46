"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import slices

BUCKETS = 1 << 15
MAX_N = 3
SLICE = 1 << 19
UNDETERMINED = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams (1 to 3) of lower-cased texts, where a run of other signs is one space.

    Returns the buckets, the text of each, and whether a text has a letter.
    N-grams that would cross from one text into the next get bucket ``buckets``.
    """
    sizes, parts = [], []
    for t in texts:
        low = t.lower()
        parts.append(low)
        sizes.append(len(low) + 1)
    codes = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[codes]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    ends = np.cumsum(sizes) - 1
    keep[ends] = True
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes[ends] = 0
    codes, owner = codes[keep], owner[keep]
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    found, owners = [], []
    value, apart = np.zeros(len(codes), np.uint64), np.zeros(len(codes), bool)
    for n in range(MAX_N):
        if n >= len(codes):
            break
        size = len(codes) - n
        value = (value[:size] * _MIX[1]) ^ (codes[n:] * _MIX[0])
        apart = apart[:size] | (codes[n:] == 0)
        bucket = ((value * _MIX[2]) >> shift).astype(np.int32)
        bucket[apart] = buckets
        found.append(bucket)
        owners.append(owner[:size])
    return np.concatenate(found), np.concatenate(owners), has


@dataclass
class LanguageModel:
    """Log-probabilities, one row per bucket, one column per language."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> LanguageModel:
    """Fit on all rows with text and language.

    Tasks count n-grams into arrays of ``buckets`` numbers per language; sums of those
    come to the driver: languages x buckets rows, whatever the number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, n in slices(batch.column(0), SLICE):
                found, owner, _ = ngram_buckets(batch.column(0).slice(first, n).to_pylist(), buckets)
                own = np.array(langs[first : first + n])
                for name in set(langs[first : first + n]):
                    mine = found[(own == name)[owner]]
                    totals[name] = totals.get(name, 0) + np.bincount(mine, minlength=buckets + 1)
                    totals[name][buckets] = 0
                    totals.setdefault(f"\0{name}", np.zeros(1, np.int64))[0] += int((own == name).sum())
        for name, n in totals.items():
            at = np.flatnonzero(n)
            docs = name[0] == "\0"
            yield pa.RecordBatch.from_arrays(
                [pa.array([name[1:] if docs else name] * len(at), pa.string()), pa.array(np.full(len(at), -1) if docs else at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"]
            )

    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & (F.col(lang) != "")).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    names = sorted(found["lang"].unique())
    at = {x: k for k, x in enumerate(names)}
    table = np.zeros((buckets + 1, len(names)))
    docs = np.zeros(len(names))
    column = found["lang"].map(at).to_numpy(dtype=np.int64)
    grams = (found["bucket"] >= 0).to_numpy()
    np.add.at(table, (found["bucket"].to_numpy()[grams], column[grams]), found["n"].to_numpy()[grams])
    np.add.at(docs, column[~grams], found["n"].to_numpy()[~grams])
    weights = np.log((table[:-1] + smoothing) / (table[:-1].sum(0) + smoothing * buckets)) if names else table[:-1]
    weights = np.vstack([weights, np.zeros(len(names))]).astype(np.float32)
    return LanguageModel(names, weights, np.log(np.maximum(docs, 1) / max(docs.sum(), 1)))


def score(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Best language and its posterior. Ties go to the first name."""
    n = len(model.languages)
    if not n or not texts:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    found, owner, has = ngram_buckets(texts, len(model.weights) - 1)
    total = np.empty((len(texts), n))
    for k in range(n):
        total[:, k] = np.bincount(owner, model.weights[found, k], minlength=len(texts))
    total += model.priors
    best = total.argmax(1)
    share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if h else UNDETERMINED for b, h in zip(best, has)], np.where(has, share, 0.0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns with ``lang_pred`` and ``score`` (these two names are replaced if there).

    The matrix is broadcast: languages x buckets numbers, fixed by the parameters and not
    by the data. ``und`` with score 0 if the text is NULL or has no letter, or nothing was
    learned. Texts are read whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(F.col(text).alias("_text_"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column(0), SLICE):
                part = batch.slice(first, n)
                names, shares = score(shared.value, [t or "" for t in part.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=[*kept, "lang_pred", "score"])

    out = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, out)


def held_out(key: str = "doc_id") -> Column:
    """A fixed quarter of the documents, by key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
