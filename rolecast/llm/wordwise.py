"""Ids of whole Arrow columns of texts, word by word.

A column is cut at single spaces and line breaks in Arrow and its words are dictionary-encoded,
so each distinct word of a slice is looked up once; the ids of all occurrences are then
gathered by place. What a word's ids are, and which words cannot stand alone, is the coder's part.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONGEST_CACHED = 64


class Found(NamedTuple):
    """Ids of words: word k has ``sizes[k]`` of them from ``places[k]`` on; a size of -1 is a word that cannot stand alone."""

    ids: np.ndarray
    places: np.ndarray
    sizes: np.ndarray


def packed(found: list[bytes | None]) -> Found:
    """Ids given as packed 32-bit integers for each word, None for a word that cannot stand alone."""
    sizes = np.fromiter((-1 if x is None else len(x) // 4 for x in found), np.int32, len(found))
    held = np.maximum(sizes, 0)
    return Found(np.frombuffer(b"".join(x for x in found if x), "<u4"), np.cumsum(held, dtype=np.int32) - held, sizes)


def gathered(ids: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of all words, one word after the other."""
    # 32 bits are enough: a column has less than 2^31 bytes, and a token has one at least.
    at = places - (np.cumsum(sizes, dtype=np.int32) - sizes)
    at = np.repeat(at, sizes)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at] if len(ids) else ids


class Memory:
    """Results by word, as Arrow strings and arrays of ids, so a word takes some 30 bytes; when full, the words of the last call stay.

    Bounds memory and changes no result. ``make`` gives the results of a list of new words.
    """

    def __init__(self, make: Callable[[list[str]], Found], limit: int) -> None:
        self.make, self.limit = make, max(1, limit)
        self.words, self.found = pa.array([], pa.string()), packed([])

    def all(self, words: pa.Array) -> Found:
        """Results of distinct words."""
        words = words.cast(pa.string())
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return Found(self.found.ids, self.found.places[at], self.found.sizes[at])
        unknown = words.take(pa.array(missing))
        old, new = self.found, self.make(strings(unknown))
        at[missing] = len(self.words) + np.arange(len(missing), dtype=np.int32)
        ids = np.concatenate([old.ids, new.ids])
        places = np.concatenate([old.places, new.places + np.int32(len(old.ids))])[at]
        sizes = np.concatenate([old.sizes, new.sizes])[at]
        out = Found(ids, places, sizes)
        self._keep(words, out) if len(self.words) + len(unknown) > self.limit else self._keep(unknown, new, self.words, old)
        return out

    def _keep(self, words: pa.Array, found: Found, before: pa.Array | None = None, old: Found | None = None) -> None:
        """The words that are not too long, behind those of ``before``."""
        short = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) <= LONGEST_CACHED)[: self.limit]
        sizes = found.sizes[short]
        held = np.maximum(sizes, 0)
        new = Found(gathered(found.ids, found.places[short], held), np.cumsum(held, dtype=np.int32) - held, sizes)
        words = words.take(pa.array(short))
        if before is None or old is None:
            self.words, self.found = words, new
            return
        self.words = pa.concat_arrays([before, words])
        self.found = Found(np.concatenate([old.ids, new.ids]), np.concatenate([old.places, new.places + np.int32(len(old.ids))]), np.concatenate([old.sizes, new.sizes]))


def strings(column: pa.Array) -> list[str | None]:
    """The values of a text column; much faster than ``to_pylist`` for many short ones."""
    return column.to_numpy(zero_copy_only=False).tolist()


def column_ids(texts: pa.Array, first: Callable[[pa.Array], Found], later: Callable[[pa.Array], Found], whole: Callable[[str], bytes], breaks: bool = True, apart: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts, one after the other, and the number of ids of each text.

    ``first`` and ``later`` give the ids of distinct words: of words at the beginning
    of a text and of words behind a space. With ``breaks`` a line break begins a
    word of its own. Texts with a word that cannot stand alone, and the rows marked in
    ``apart``, are handed to ``whole``. NULL is an empty text.
    """
    texts = pc.fill_null(texts, "")
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if breaks else texts, " ")
    begin = cut.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = cut.values.slice(begin[0], begin[-1] - begin[0])
    begin -= begin[0]
    coded = values.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    heads = begin[:-1]
    begun = values.take(pa.array(heads)).dictionary_encode()
    a, b = later(coded.dictionary), first(begun.dictionary)
    codes[heads] = len(a.sizes) + begun.indices.to_numpy(zero_copy_only=False)
    ids, sizes = np.concatenate([a.ids, b.ids]), np.concatenate([a.sizes, b.sizes])
    places = np.concatenate([a.places, b.places + np.int32(len(a.ids))])

    rows = np.zeros(len(heads), bool) if apart is None else np.array(apart.to_numpy(zero_copy_only=False), bool)
    if (sizes < 0).any():
        rows |= np.logical_or.reduceat((sizes < 0)[codes], heads)
        sizes = np.maximum(sizes, 0)
    count = sizes[codes]
    lengths = np.add.reduceat(count, heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)
    out = gathered(ids, places[codes], count)
    if not rows.any():
        return out, lengths
    ends = np.cumsum(lengths)
    parts: list[np.ndarray] = []
    begun = 0
    for k in np.flatnonzero(rows):
        parts.append(out[begun : ends[k] - lengths[k]])
        parts.append(np.frombuffer(whole(texts[int(k)].as_py()), "<u4"))
        begun, lengths[k] = ends[k], len(parts[-1])
    return np.concatenate([*parts, out[begun:]]), lengths


def row_bytes(ids: np.ndarray, lengths: np.ndarray, tail: bytes = b"") -> list[bytes]:
    """The packed ids of each text, with ``tail`` behind."""
    data, ends = ids.astype("<u4").tobytes(), (np.cumsum(lengths) * 4).tolist()
    return [data[a:b] + tail for a, b in zip([0, *ends], ends)]
