"""Token ids of whole texts by the ``tokenizers`` library, remembered by word."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rolecast.llm.wordwise import Found, Memory, column_ids, gathered, packed

CACHED_WORDS = 500_000
#: Pieces that the library gets at once; it holds some hundred bytes for each.
PIECES = 2048
#: Up to here all Unicode versions agree on what is a letter, a digit and white space.
SETTLED = "ɐ"


def byte_signs() -> list[str]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in visible}
    return [signs.setdefault(b, chr(256 + len(signs) - len(visible))) for b in range(256)]


# The zero byte stands between pieces.
_SIGNS = {**dict(enumerate(byte_signs())), 0: " "}


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A byte-level BPE cuts a text before every single space that a visible character
    follows, and around a single line break; ids of the parts are then independent and
    are looked up by word. The pieces of new words go, byte by byte as signs, to the library's BPE model, many at a time;
    the bytes of the tokens tell which word they belong to. Texts
    with other runs of white space or with an added token (``<|endoftext|>``), words with signs
    beyond U+024F and other kinds of tokenizers go through the library whole. All ways give the library's ids.
    """

    def __init__(self, tokenizer, pattern: str | None = None) -> None:
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = tokenizer
        self.added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.pieces = regex.compile(pattern).findall if pattern else None
        self.bare_model = Tokenizer(tokenizer.model)
        self.bare_model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int32)
        self.sizes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.spaced = Memory(lambda words: self._new_words(" ", words), CACHED_WORDS)
        self.bare = Memory(lambda words: self._new_words("\n", words), CACHED_WORDS // 6)
        self.line = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _new_pieces(self, pieces: list[str]) -> np.ndarray:
        """Ids of matches of the pattern, which hold no zero byte, one after the other."""
        ids = array("I")
        for at in range(0, len(pieces), PIECES):
            signs = "\0".join(pieces[at : at + PIECES]).encode().decode("latin-1").translate(_SIGNS)
            ids.extend(self.bare_model.encode_batch_fast([signs], add_special_tokens=False)[0].ids)
        return np.frombuffer(ids, "<u4")

    def _new_words(self, before: str, words: list[str]) -> Found:
        """Ids of words behind a space, or of words at the beginning of a line.

        With other white space around (also the empty word) a word's ids depend on its neighbours: -1.
        """
        other: list[bytes | None] = [None] * len(words)
        plain, lines = [], []
        for k, w in enumerate(words):
            if not w:
                other[k] = None if before == " " else b""
            elif w[0] == "\n" and before == " ":
                lines.append(k)
            elif "\0" in w or not (w.isascii() or max(w) < SETTLED):
                other[k] = self.whole((before if before == " " else "") + w) if w.split() == [w] else None
            else:
                plain.append(k)
        joined = before + before.join([words[k] for k in plain])
        if joined.split() != [words[k] for k in plain]:
            plain = [k for k in plain if words[k].split() == [words[k]]]
            joined = before + before.join([words[k] for k in plain])
        new = self._new_pieces(self.pieces(joined)) if plain else np.zeros(0, "<u4")
        ends = np.cumsum(self.sizes[new])
        data = np.frombuffer(joined.encode(), np.uint8)
        if plain and (not len(ends) or ends[-1] != len(data)):
            # The vocabulary lacks the sign of a byte, so tokens do not tell where words begin.
            for k in plain:
                other[k] = self.whole((before if before == " " else "") + words[k])
            plain = []
        ids, places, sizes = packed(other)
        if plain:
            # A word begins with what stands before it; a line break is a piece of its own.
            breaks = np.flatnonzero(data == ord(before))
            starts = np.searchsorted(ends, breaks + int(before == "\n"), side="right").astype(np.int32)
            stops = np.searchsorted(ends, np.append(breaks[1:], len(data)), side="right").astype(np.int32)
            places[plain], sizes[plain] = starts + np.int32(len(ids)), stops - starts
            ids = np.concatenate([ids, new])
        if lines:
            rest = self.bare.all(pa.array([words[k][1:] for k in lines], pa.string()))
            line = np.frombuffer(self.line, "<u4")
            # The break at the end of a text or before another one belongs to a longer run.
            alone = rest.sizes <= 0
            held = np.where(alone, 0, rest.sizes)
            total = np.where(alone, 0, held + len(line)).astype(np.int32)
            first = np.cumsum(total, dtype=np.int32) - total
            both = np.zeros(int(total.sum()), "<u4")
            begin = np.zeros(len(both) + 1, bool)
            for k, x in enumerate(line):
                begin[first[~alone] + k] = True
                both[first[~alone] + k] = x
            both[~begin[:-1]] = gathered(rest.ids, rest.places, held)
            places[lines], sizes[lines] = first + np.int32(len(ids)), np.where(alone, -1, total)
            ids = np.concatenate([ids, both])
        return Found(ids, places, sizes)

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, one text after the other, and the number of ids of each text; NULL is empty."""
        if self.pieces is None:
            found = [self.whole(t or "") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        apart = None
        for sign in self.added:
            here = pc.fill_null(pc.match_substring(texts, sign), False)
            apart = here if apart is None else pc.or_(apart, here)
        return column_ids(texts, self.bare.all, self.spaced.all, self.whole, apart=apart)

    def __call__(self, text: str) -> bytes:
        return self.column(pa.array([text], pa.string()))[0].tobytes()


def _cuts_at_spaces(tokenizer) -> bool:
    import json

    kind = json.loads(tokenizer.to_str())
    before = kind.get("pre_tokenizer") or {}
    return kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")


#: What the library's byte-level cutter matches.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file; one per Python worker, shared by its tasks."""
    # One Spark task is one thread of work.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return TextEncoder(tokenizer, BYTE_LEVEL_PATTERN if _cuts_at_spaces(tokenizer) else None)


def vocabulary_bits(path: str, *extra: int) -> int:
    """The least bits that hold every id of the vocabulary and the extra ids."""
    from tokenizers import Tokenizer

    return max(1, max(Tokenizer.from_file(path).get_vocab_size() - 1, *extra, 0).bit_length())
