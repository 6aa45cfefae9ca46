"""Byte-level BPE from a table of ranks: encoding and decoding by the ``tokenizers`` library.

The table gives each token's bytes and its rank, which is also its id. The library's model works on
signs, so each byte gets a sign of its own, and on merges, so each token's two halves are found
by merging its bytes with all better ranks. Texts come as Arrow batches; ids leave packed. Decoding
reverses the table of signs and glues bytes, so a character that is split over tokens is
whole again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rolecast.llm.common import list_array, slices
from rolecast.llm.tokens import BYTE_LEVEL_PATTERN, TextEncoder, byte_signs
from rolecast.llm.wordwise import row_bytes


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """The encoding by its definition: join the two neighbours whose whole has the least rank, leftmost first, while it is under ``below``."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while len(parts) > 1:
        found = [ranks.get(a + b, below) for a, b in zip(parts, parts[1:])]
        least = min(found)
        if least >= below:
            break
        at = found.index(least)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairs:
    """Encoder and decoder of one table of ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the table has no token for some single byte")
        signs = dict(enumerate(byte_signs()))
        name = lambda token: token.decode("latin-1").translate(signs)
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                halves = merged(token, ranks, rank)
                if len(halves) != 2:
                    raise ValueError(f"token {rank} is not a merge of two tokens with better ranks")
                merges.append((name(halves[0]), name(halves[1])))
        model = models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encoder = TextEncoder(tokenizer, pattern if pattern == BYTE_LEVEL_PATTERN else None)
        back = {sign: byte for byte, sign in signs.items()}
        size = max(ranks.values()) + 1
        tokens = [bytes(back[s] for s in tokenizer.id_to_token(k) or "") for k in range(size)]
        self.known = np.array([bool(t) for t in tokens])
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the table")
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        return self.bytes[np.repeat((self.places[ids] - before).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)]

    def decode_rows(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The bytes of each text; long runs of texts are taken a part at a time."""
        out: list[bytes] = []
        ends = np.cumsum(lengths)
        begin = ends - lengths
        row = 0
        while row < len(ends):
            to = max(row + 1, int(np.searchsorted(ends, begin[row] + (1 << 20), side="right")))
            part = ids[begin[row] : ends[to - 1]]
            data, stops = self.decode(part).tobytes(), np.concatenate([[0], np.cumsum(self.sizes[part])])
            cuts = stops[ends[row:to] - begin[row]].tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
            row = to
        return out

    def spans(self, texts: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and the one after the last of each token. Tokens that share a split character overlap."""
        texts = pc.fill_null(texts, "")
        data = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
        nr = np.cumsum((data & 0xC0) != 0x80) - 1  # character of each byte
        ends = np.cumsum(self.sizes[ids])
        row = np.repeat(np.cumsum(chars := pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) - chars, lengths)
        return nr[ends - self.sizes[ids]] - row, nr[ends - 1] + 1 - row


@lru_cache(maxsize=2)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One per Python worker, shared by its tasks."""
    return BytePairs(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """``(key, ids binary)`` of whole texts, ids as little-endian unsigned 32-bit integers; with ``offsets`` also
    ``starts`` and ``ends``, the characters that each token covers.

    Each match of ``pattern`` is encoded by itself and no special token is looked for. NULL and empty texts have no
    ids. Works row by row: a NULL key, repeated rows and an empty table need no rule of their own; other columns are ignored.
    Long texts are slices of their own.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks, pattern)
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                texts = batch.column(1).slice(first, count)
                ids, lengths = pairs.encoder.column(texts)
                out = {key: batch.column(0).slice(first, count), "ids": pa.array(row_bytes(ids, lengths), pa.binary())}
                if offsets:
                    for name, values in zip(("starts", "ends"), pairs.spans(texts, ids, lengths)):
                        out[name] = list_array(values, lengths, pa.int32())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids binary" + (", starts array<int>, ends array<int>" if offsets else ""))


def decode_ids(encoded: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, decoded binary)`` from packed ids; NULL and empty ids give no bytes, an id outside the table is an error.

    Bytes are returned as they are: a list of ids may end inside a character. ``make_valid_utf8(cast(decoded AS STRING))`` is
    the text with a replacement sign there.
    """
    kind = encoded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks, pattern)
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                packed = [x or b"" for x in batch.column(1).slice(first, count).to_pylist()]
                found = pairs.decode_rows(np.frombuffer(b"".join(packed), "<u4"), np.array([len(x) // 4 for x in packed], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), pa.array(found, pa.binary())], names=[key, "decoded"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, decoded binary")


def encode_decode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids binary, decoded binary)``: ``encode_texts`` and ``decode_ids`` in one pass; ``decoded`` comes from the ids alone."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks, pattern)
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                ids, lengths = pairs.encoder.column(batch.column(1).slice(first, count))
                columns = [batch.column(0).slice(first, count), pa.array(row_bytes(ids, lengths), pa.binary()), pa.array(pairs.decode_rows(ids, lengths), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids binary, decoded binary")
