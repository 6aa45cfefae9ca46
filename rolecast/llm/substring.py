"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text (each step doubles the hash and adds a fixed number
for the byte; 16 bytes count). A place cuts where its hash is the least within
16 bytes on both sides, moved to the next word's start. Cuts depend on nearby bytes only, so
an insertion changes the chunks around it and no others. Chunks are 33 bytes in the
mean and vary between 17 and a few hundred.

Chunks are compared by digest over all documents. The first document (smallest key) keeps a chunk,
inside a document its first place does. Runs of repeated chunks of at
least ``min_bytes`` are cut out; shorter repeats (phrases, single lines) stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import list_array, slices, written

RADIUS = 16
REACH = 64
MIN_BYTES = 150


def _gear_table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, over 16 bytes, by doubling."""
    value = _GEAR[data]
    for span in (1, 2, 4, 8):
        if span >= len(value):
            break
        longer = value.copy()
        longer[span:] += value[:-span] << np.uint32(span)
        value = longer
    return value


def chunk_ends(text: bytes, radius: int = RADIUS) -> np.ndarray:
    """Ends of the chunks of UTF-8 text; the last is its length."""
    n = len(text)
    if n <= 2 * radius + 1:
        return np.array([n] if n else [], np.int64)
    data = np.frombuffer(text, np.uint8)
    value = gear_hashes(data)
    before, width = value, 1
    while width * 2 <= radius:
        before = np.minimum(before[:-width], before[width:])
        width *= 2
    if width < radius:
        before = np.minimum(before[: len(before) - (radius - width)], before[radius - width :])
    # before[i] is the least of value[i : i + radius]
    middle = value[radius : n - radius]
    cuts = np.flatnonzero((middle < before[: n - 2 * radius]) & (middle <= before[radius + 1 : n - radius + 1])) + radius
    blanks = np.flatnonzero(_SPACE[data])
    at = np.searchsorted(blanks, cuts)
    to_blank = np.append(blanks, n + REACH + 1)[at] + 1
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    to_sign = np.append(starts, n)[np.searchsorted(starts, cuts)]
    ends = np.where(to_blank - cuts <= REACH, to_blank, to_sign)
    return np.unique(np.append(ends[(ends > 0) & (ends < n)], n))


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, mark, digests, ends, again)`` per row: 64-bit digests, places in bytes.

    A chunk starts where the one before it ends.
    ``again`` marks a chunk that came before in the same text; ``mark`` is a hash of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts = batch.column(1)
            for first, count in slices(texts, 4 << 20):
                sizes, digests, ends, again = [], [], [], []
                for t in texts.slice(first, count).cast(pa.binary()).to_pylist():
                    cut = chunk_ends(t or b"")
                    sizes.append(len(cut))
                    if not len(cut):
                        continue
                    begin = np.concatenate([[0], cut[:-1]])
                    found = np.fromiter((digest(t[a:b]) for a, b in zip(begin.tolist(), cut.tolist())), np.uint64, len(cut))
                    repeat = np.ones(len(cut), bool)
                    repeat[np.unique(found, return_index=True)[1]] = False
                    digests.append(found.view(np.int64))
                    ends.append(cut)
                    again.append(repeat)
                flat = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, count), batch.column(2).slice(first, count), list_array(flat(digests, np.int64), sizes, pa.int64()),
                     list_array(flat(ends, np.int32), sizes, pa.int32()), list_array(flat(again, bool), sizes, pa.bool_())],
                    names=["doc", "mark", "digests", "ends", "again"],
                )

    kind = "doc long, mark long, digests array<long>, ends array<int>, again array<boolean>"
    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("t"), F.xxhash64(text).alias("mark")).where("doc is not null").mapInArrow(run, kind)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(doc, mark, spans)`` of the rows that lose text: sorted byte spans ``(start, end)``."""
    made = written(chunks(docs, key, text), "chunks")
    rows = made.select("doc", F.explode(F.arrays_zip("digests", "again")).alias("c")).select("doc", "c.*")
    once = rows.where("not again").select("doc", "digests")
    # Summed per task before the shuffle, so a chunk of very many documents is a few rows.
    first = once.groupBy("digests").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("digests", "first")
    elsewhere = once.join(first, "digests").where("doc <> first").groupBy("doc").agg(F.collect_list("digests").alias("later"))
    # Runs are found from the chunks' own list; nothing but digests was shuffled for it.
    with_later = made.join(elsewhere, "doc", "left").where(F.col("later").isNotNull() | F.exists("again", lambda x: x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, later, digests, ends, again, marks = (batch.column(k) for k in range(6))
            out_doc, out_mark, out = [], [], []
            for k in range(batch.num_rows):
                end = np.asarray(ends[k].values)
                begin = np.concatenate([[0], end[:-1]])
                gone = np.asarray(again[k].values.to_numpy(zero_copy_only=False), bool)
                if later[k].is_valid:
                    gone = gone | np.isin(np.asarray(digests[k].values), np.asarray(later[k].values))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                runs = [(int(begin[a]), int(end[b - 1])) for a, b in zip(edge[::2], edge[1::2])]
                runs = [r for r in runs if r[1] - r[0] >= min_bytes]
                if runs:
                    out_doc.append(docs_[k].as_py())
                    out_mark.append(marks[k].as_py())
                    out.append([{"start": a, "end": b} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_doc, pa.int64()), pa.array(out_mark, pa.int64()), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc", "mark", "spans"])

    return with_later.select("doc", "later", "digests", "ends", "again", "mark").mapInArrow(run, "doc long, mark long, spans array<struct<start: int, end: int>>")


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """All columns of ``docs``, the text without repeated passages, and ``cut_spans``.

    ``cut_spans`` are the byte spans of the old text that were cut out (empty: untouched). A NULL text stays
    NULL and an empty one empty; rows without a key are neither compared nor changed. Rows of
    one key with the same text count as one document and get the same result; with different texts each is
    compared with the other keys and with itself. A column called ``cut_spans`` is replaced;
    an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() != "cut_spans"]
    found = repeated_spans(docs, key, text, min_bytes).groupBy(F.col("doc").alias("_cut_doc"), F.col("mark").alias("_cut_mark")).agg(F.max("spans").alias("cut_spans"))
    nothing = F.array().cast("array<struct<start: int, end: int>>")
    same = (F.col(key).cast("long") == F.col("_cut_doc")) & (F.xxhash64(text) == F.col("_cut_mark"))
    joined = docs.select(*kept).join(found, same, "left").withColumn("cut_spans", F.coalesce("cut_spans", nothing))
    raw = F.encode(text, "UTF-8")
    ends = F.concat(F.transform("cut_spans", lambda s: s.start), F.array(F.octet_length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform("cut_spans", lambda s: s.end))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.decode(F.substring(raw, p.a + 1, p.b - p.a), "UTF-8"))
    left = F.when(F.size("cut_spans") > 0, F.array_join(parts, "")).otherwise(F.col(text))
    return joined.select(*[left.alias(c) if c == text else F.col(c) for c in kept], "cut_spans")
