"""SentencePiece BPE: exact encoding by backtracking, and decoding.

An encoding is right exactly when each piece encodes to itself and each two adjacent pieces,
glued together, encode to those two again. So a text is cut greedily: the
longest piece at each place (found by an Aho-Corasick automaton), then the next shorter one while
the pair with its predecessor fails that test, and back by one piece where none is left. A
bitfield marks places from which no way leads on; each place fails once.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import list_array, slices
from rolecast.llm.wordwise import Memory, column_ids, packed

SPACE = "▁"
CACHED_WORDS = 800_000
CACHED_PAIRS = 2_000_000


class PieceModel:
    """Vocabulary, scores and the exact encoder of one model file."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            data = file.read()
        proto.ParseFromString(data)
        kind, norm = proto.trainer_spec, proto.normalizer_spec
        if kind.model_type != kind.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not kind.byte_fallback:
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.text = {k: p for p, k in self.ids.items()}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == p.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == p.BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space after another sign")
        self.lines = not any("\n" in p for p in self.ids)
        self.signs = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.library = SentencePieceProcessor(model_proto=data)
        self.ordered = True
        self._split: dict[str, tuple[str, str] | None] = {}
        self._after: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._shorter: dict[str, str | None] = {}
        self._words = Memory(lambda words: packed([self._behind_space(w) for w in words]), CACHED_WORDS)
        # A text that begins with a space or a line break is taken whole.
        self._heads = Memory(lambda words: packed([self.encode_part(self.prefix + w) if w else None for w in words]), CACHED_WORDS // 8)

    def merge(self, text: str, stop: str | None = None) -> list[str]:
        """The encoding by its definition: join the adjacent pair with the best score, leftmost first.

        With ``stop``, ends before the merge that makes that piece.
        """
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0 or parts[at] + parts[at + 1] == stop:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made this one; None for a single sign and for a piece that its merges do not make."""
        if piece not in self._split:
            self._split[piece] = None if len(piece) == 1 else self._last_merge(piece)
        return self._split[piece]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        parts = self.merge(piece, stop=piece)
        if len(parts) != 2:
            return None
        if any(len(p) > 1 and self.score[p] < self.score[piece] for p in parts):
            self.ordered = False  # a part that ranks behind its whole
        return parts[0], parts[1]

    def _apart(self, left: str, right: str) -> bool:
        """Would these two neighbours stay apart if merged anew from single signs?

        Walks their merges backward, the later one first: each two inner ends that once
        stood beside each other must not have merged before one of them went into its next merge. On
        equal scores the merge further left comes first.
        """
        score = self.score
        if left + right in score:
            return False
        while True:
            one, two = self._halves(left), self._halves(right)
            if one is None and two is None:
                return True
            if two is None or (one is not None and score[left] < score[right]):
                limit, left = score[left], one[1]
                if score.get(left + right, limit) > limit:
                    return False
            else:
                limit, right = score[right], two[0]
                if (s := score.get(left + right)) is not None and s >= limit:
                    return False

    def _fits(self, last: str, piece: str) -> bool:
        """May ``piece`` stand here, after ``last`` (empty at the beginning)? Remembers the answer."""
        if last:
            if self._pairs >= CACHED_PAIRS:
                self._after.clear()
                self._pairs = 0
            self._pairs += 1
            found = self._fits("", piece) and (self._apart(last, piece) if self.ordered else self.merge(last + piece) == [last, piece])
        else:
            found = len(piece) == 1 or self._halves(piece) is not None
        self._after.setdefault(last, {})[piece] = found
        return found

    def _next_shorter(self, piece: str) -> str | None:
        if piece not in self._shorter:
            self._shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), None)
        return self._shorter[piece]

    def _known(self, text: str) -> list[str]:
        """Pieces of a text all of whose signs are in the vocabulary."""
        size = len(text)
        longest = [1] * size
        for end, n in self.automaton.iter(text):
            end -= n - 1
            if n > longest[end]:
                longest[end] = n
        failed = 0
        out: list[str] = []
        at, piece, last = 0, text[: longest[0]], ""
        while True:
            known = self._after.get(last) or {}
            while piece is not None:
                end = at + len(piece)
                if not failed >> end & 1:
                    fits = known.get(piece)
                    if fits or (fits is None and self._fits(last, piece)):
                        break
                piece = self._next_shorter(piece)
            if piece is not None:
                out.append(piece)
                at, last = end, piece
                if at == size:
                    return out
                piece = text[at : at + longest[at]]
            else:
                failed |= 1 << at
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""
                # The same piece ends at a failed place now, so the next shorter one is tried.

    def encode_part(self, text: str) -> bytes:
        """Packed ids of a run of signs. Signs outside the vocabulary become their bytes and stand alone."""
        if text and self.signs.issuperset(text):
            return array("i", [self.ids[p] for p in self._known(text)]).tobytes()
        ids: list[int] = []
        start = 0
        for k in range(len(text) + 1):
            if k == len(text) or text[k] not in self.ids:
                if start < k:
                    ids += [self.ids[p] for p in self._known(text[start:k])]
                if k < len(text):
                    ids += [self.bytes[b] for b in text[k].encode()]
                start = k + 1
        return array("i", ids).tobytes()

    def _behind_space(self, word: str) -> bytes | None:
        """A line break before a word takes the space's place; an empty word belongs to a run of spaces."""
        if not word:
            return None
        return self.encode_part("\n") + self.encode_part(word[1:]) if self.lines and word[0] == "\n" else self.encode_part(SPACE + word)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, one text after the other, and the number of ids of each text; NULL is empty."""
        ids, lengths = column_ids(pc.replace_substring(texts, SPACE, " "), self._heads.all, self._words.all, self.encode, breaks=self.lines)
        return ids.view("<i4"), lengths

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers.

        No piece joins a sign with a later space, so words are encoded one by one; a run of spaces stays with the word behind it.
        """
        if not text:
            return b""
        word, out = self.encode_part, []
        lines = text.replace(SPACE, " ").split("\n") if self.lines else [text.replace(SPACE, " ")]
        for nr, line in enumerate(lines):
            words = line.split(" ")
            if nr:
                out.append(word("\n"))
            held = "" if nr else self.prefix
            if "" not in words:
                out.append(word(held + words[0]))
                out += [word(SPACE + w) for w in words[1:]]
                continue
            for k, w in enumerate(words):
                held += SPACE if k else ""
                if w:
                    out.append(word(held + w))
                    held = ""
            if held:
                out.append(word(held))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per Python worker, shared by its tasks."""
    return PieceModel(path)


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` of whole texts; NULL and empty texts have no ids.

    Works row by row: a NULL key, repeated rows and an empty table need no rule of their
    own; other columns are ignored. A space before any number of characters, control signs and
    characters outside the vocabulary (by their bytes) are encoded as the library does.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_model(model).column
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                flat, lengths = encode(batch.column(1).slice(first, count))
                ids = list_array(flat, lengths, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), ids], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def encode_decode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>, decoded)``: ``encode_texts`` and ``decode_ids`` in one pass over the texts."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                flat, lengths = pieces.column(batch.column(1).slice(first, count))
                ends = np.cumsum(lengths).tolist()
                decoded = [pieces.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), list_array(flat, lengths, pa.int32()), pa.array(decoded, pa.string())], names=[key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, ids, decoded)``; NULL and empty lists give an empty text."""
    kind = encoded.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = piece_model(model).decode
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decode(x or []) for x in part.column(1).to_pylist()], pa.string())], names=[key, "ids", "decoded"])

    return encoded.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"{key} {kind}, ids array<int>, decoded string")
