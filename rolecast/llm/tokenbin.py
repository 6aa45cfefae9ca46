"""Token-id files: fixed-width bit packing with block offsets.

A file holds blocks and a footer. All numbers are little-endian::

    block   n_docs u64 | n_ids u64 | keys i64[n_docs] | has_key u8[n_docs] | lengths u64[n_docs] | packed ids
    footer  first_id u64, offset u64, length u64 for each block | n_blocks u64 | bits u64 | b"TOKENIDS"

Each id takes the least number of bits that holds the whole vocabulary; id ``i`` of a
block starts at bit ``i * bits``, so any range is unpacked without its predecessors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecast.llm.common import slices, written
from rolecast.llm.tokens import text_encoder, vocabulary_bits
from rolecast.llm.wordwise import row_bytes
from rolecast.session import scratch_path

MAGIC = b"TOKENIDS"
BLOCK_IDS = 1 << 18
READ_BYTES = 16 << 20
_STEP = 1 << 15  # a multiple of 8: each step starts at a whole byte


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2 ** bits`` as a bit string, lowest bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), _STEP):
        planes = (ids[at : at + _STEP, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, bits: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first`` of a bit string, vectorised; at most 32 bits each."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, first * bits // 8).astype("<u4")
    start = first * bits // 8
    raw = np.frombuffer(data, np.uint8, -1, 0)[start : (first + count) * bits // 8 + 1]
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    at = (np.arange(first, first + count, dtype=np.int64)) * bits - start * 8
    byte, value = at >> 3, np.zeros(count, np.uint64)
    for k in range(5):
        value |= raw[byte + k] << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype("<u4")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = None,
    key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Encode whole texts and write their ids in ascending key order.

    Returns the saved table of blocks ``(part, block, path, offset, length, n_docs,
    n_ids, bits)``; only files that it names count, so that a repeated task does no
    harm. Rows are range-partitioned by the key and each range becomes one file. NULL and
    empty texts give the end id alone; rows without a key come first, equal keys are
    ordered by text, other columns are ignored, an empty table gives no blocks. ``folder`` must be one that all executors reach
    by ``pyarrow.fs`` (file, s3, gs, hdfs); a fresh one below ``spark.checkpoint.dir``
    is the default.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    bits = vocabulary_bits(tokenizer, end_id or 0)
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part = text_encoder(tokenizer).column, TaskContext.get().partitionId()
        out, path, held, names, blocks, at, ids_before = None, "", [], [], [], 0, 0

        def close() -> None:
            nonlocal out, path, at, ids_before
            if out is None:
                store, place = _store(folder)
                store.create_dir(place, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                path, out = f"{folder}/{name}", store.open_output_stream(f"{place}/{name}")
            ids = np.frombuffer(b"".join(held), "<u4")
            body = b"".join([
                np.array([len(held), len(ids)], "<u8").tobytes(),
                np.array([k or 0 for k in names], "<i8").tobytes(),
                np.array([k is not None for k in names], np.uint8).tobytes(),
                np.array([len(x) // 4 for x in held], "<u8").tobytes(),
                pack(ids, bits),
            ])
            out.write(body)
            blocks.append((part, len(blocks), path, at, len(body), len(held), len(ids), bits, ids_before))
            at, ids_before = at + len(body), ids_before + len(ids)
            held.clear()
            names.clear()

        size = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, count in slices(batch.column(1), 4 << 20):
                for k, ids in enumerate(row_bytes(*encode(batch.column(1).slice(first, count)), tail), first):
                    held.append(ids)
                    names.append(keys[k])
                    size += len(held[-1]) // 4
                    if size >= block_ids:
                        close()
                        size = 0
        if held:
            close()
        if out is not None:
            index = np.array([(b[8], b[3], b[4]) for b in blocks], "<u8").tobytes()
            out.write(index + np.array([len(blocks), bits], "<u8").tobytes() + MAGIC)
            out.close()
            columns = list(zip(*blocks))[:8]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=_NAMES)

    ranged = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange("k").sortWithinPartitions("k", "t")
    return written(ranged.mapInArrow(write, _BLOCKS), "token-blocks")


_BLOCKS = "part int, block int, path string, offset long, length long, n_docs long, n_ids long, bits int"
_NAMES = [x.split(" ")[0] for x in _BLOCKS.split(", ")]


def read_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, start, n_tokens, ids)`` of each document, read from the files.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit integers. Blocks are read by their offsets, about 16 MB a task.
    """
    # One row for each file here; the running sums inside a file need only its own blocks.
    files = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = files.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")
    placed = blocks.withColumn("inside", inside).join(before, "part")
    total = blocks.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // READ_BYTES))
    rows = placed.select("path", "offset", "length", "bits", (F.col("before") + F.col("inside")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, place = _store(row["path"])
                with store.open_input_file(place) as file:
                    body = file.read_at(row["length"], row["offset"])
                keys, has, lengths, ids = parse_block(body, row["bits"])
                starts = row["start"] + np.cumsum(lengths) - lengths
                ends = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths * 4, out=ends[1:])
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=~has), pa.array(starts), pa.array(lengths), data.cast(pa.binary())], names=[key, "start", "n_tokens", "ids"]
                )

    return rows.repartition(tasks, "path", "offset").mapInArrow(read, f"{key} long, start long, n_tokens long, ids binary")


def parse_block(body: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, whether they are set, lengths and ids of a block."""
    n, total = (int(x) for x in np.frombuffer(body, "<u8", 2))
    keys = np.frombuffer(body, "<i8", n, 16)
    has = np.frombuffer(body, np.uint8, n, 16 + 8 * n).astype(bool)
    lengths = np.frombuffer(body, "<u8", n, 16 + 9 * n).astype(np.int64)
    return keys, has, lengths, unpack(body[16 + 17 * n :], bits, 0, total)


def ids_at(path: str, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first`` of one file, reading only the blocks that hold them."""
    store, place = _store(path)
    with store.open_input_file(place) as file:
        size = file.size()
        n, bits = (int(x) for x in np.frombuffer(file.read_at(16, size - 24), "<u8"))
        index = np.frombuffer(file.read_at(24 * n, size - 24 - 24 * n), "<u8").reshape(n, 3).astype(np.int64)
        out = []
        for k in range(max(0, int(np.searchsorted(index[:, 0], first, side="right")) - 1), n):
            begin, offset, _ = (int(x) for x in index[k])
            if begin >= first + count:
                break
            docs, total = (int(x) for x in np.frombuffer(file.read_at(16, offset), "<u8"))
            low, high = max(first - begin, 0), min(first + count - begin, total)
            if low < high:
                base, byte = offset + 16 + 17 * docs, low * bits // 8
                out.append(unpack(file.read_at((high * bits + 7) // 8 - byte, base + byte), bits, 0, high - low) if low * bits % 8 == 0 else unpack(file.read_at((high * bits + 7) // 8, base), bits, low, high - low))
    return np.concatenate(out) if out else np.zeros(0, "<u4")
