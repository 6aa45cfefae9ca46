"""Which texts contain which short texts, as joins or within a task.

As joins, every needle is looked for through one of its character triples, the one that the fewest texts have, and
what shares that triple is then compared as a whole. So texts and needles meet in equi-joins and not pair by pair.
A task that has all needles of a block (``Finder``) reads each text once for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.session import scratch_path

GRAM = 3


def _grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of a text; of a shorter text, the text itself."""

    def cut(signs: Column) -> Column:
        runs = F.transform(signs, lambda c, k: F.concat(c, *[F.coalesce(F.get(signs, k + n), F.lit("")) for n in range(1, size)]) if size > 1 else c)
        return F.array_distinct(F.slice(runs, 1, F.greatest(F.size(signs) - size + 1, F.lit(1))))

    # Characters once as an array, bound to a name: a substring would count from the beginning each time.
    return F.element_at(F.transform(F.array(F.split(text, "")), cut), 1)


def containing(texts: DataFrame, needles: DataFrame, key: str = "id", text: str = "text", needle: str = "needle") -> DataFrame:
    """``(key, needle)`` of all texts that contain a needle, each pair once.

    ``texts`` has unique keys; it is read twice, so it should be saved. Needles are distinct values of a frame; NULL ones find
    nothing, the empty one is in every text. A frequent triple is used only for
    needles that have no rarer one; then most texts that have it hold the needle's part too, and Spark splits the skewed join.
    """
    sought = needles.select(F.col(needle).alias("_needle")).where("_needle is not null").distinct()
    short = F.char_length("_needle") < GRAM
    of_needle = sought.where("_needle <> ''").select("_needle", F.explode(F.when(short, F.array("_needle")).otherwise(_grams(F.col("_needle")))).alias("_gram"))
    rows = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null")
    wanted = of_needle.select("_gram").distinct()
    # Pieces of the one to three lengths that needles have, and of them only those that some needle has.
    lengths = [r[0] for r in wanted.select(F.char_length("_gram")).distinct().collect()] or [GRAM]
    pieces = F.array_distinct(F.flatten(F.array(*[_grams(F.col("_text"), n) for n in sorted(lengths)])))
    posted = rows.select("_key", F.explode(pieces).alias("_gram")).join(wanted, "_gram", "left_semi")
    path = scratch_path(texts.sparkSession, "grams")
    posted.write.parquet(path)
    index = texts.sparkSession.read.parquet(path)
    frequency = index.groupBy("_gram").agg(F.count("*").alias("_df"))
    rarest = of_needle.join(frequency, "_gram", "left").groupBy("_needle").agg(F.min_by("_gram", F.struct(F.coalesce("_df", F.lit(0)), "_gram")).alias("_gram"))
    met = rarest.join(index, "_gram").select("_key", "_needle")
    found = met.join(rows, "_key").where(F.contains("_text", F.col("_needle"))).select("_key", "_needle")
    if not sought.where("_needle = ''").isEmpty():
        found = found.unionByName(rows.select("_key", F.lit("").alias("_needle")))
    return found.select(F.col("_key").alias(key), F.col("_needle").alias(needle))


_LONG = 4
_SLOT_BITS = 18
_WINDOW = 1 << 16


def _codes(data: np.ndarray, at: np.ndarray | slice, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on as one number."""
    code = data[at].astype(np.uint32)
    for k in range(1, width):
        code |= data[slice(at.start + k, at.stop + k) if isinstance(at, slice) else at + k].astype(np.uint32) << np.uint32(8 * k)
    return code


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint32(2654435761)) >> np.uint32(32 - _SLOT_BITS)


class Finder:
    """Which of a set of distinct needles stand in the texts of a batch. Texts and needles are compared by their bytes, as Spark does.

    Needles of up to three bytes are looked up by the number that their bytes make, at every place of a text. A longer one is looked for
    where the rarest four of its bytes stand and then compared as a whole; which four are rare is taken from the first texts met
    and matters for the time only. A text is taken in windows, so its length does not count.
    """

    def __init__(self, needles: Sequence[bytes]) -> None:
        self.size = np.array([len(n) for n in needles], np.int64)
        self.needles = [np.frombuffer(n, np.uint8) for n in needles]
        # For each number one more than the needle that it is: the first line of what is found is that of no needle.
        self.short = {}
        for width in range(1, _LONG):
            if (mine := np.flatnonzero(self.size == width)).size:
                self.short[width] = np.zeros(256**width, np.int32)
                for n in mine:
                    self.short[width][_codes(self.needles[n], slice(0, 1), width)] = n + 1
        self.long = np.flatnonzero(self.size >= _LONG)
        self.slots = None

    def _learn(self, data: np.ndarray) -> None:
        """Slots of the rarest four bytes of long needles, and all that is compared of them."""
        met = data[:_WINDOW]
        often = np.bincount(_slot(_codes(met, slice(0, max(0, len(met) - _LONG + 1)), _LONG)), minlength=1 << _SLOT_BITS)
        anchors, parts, places = [], [], []
        self.place = np.zeros(len(self.size), np.int64)
        for n in self.long:
            code = _codes(self.needles[n], slice(0, self.size[n] - _LONG + 1), _LONG)
            slot = _slot(code)
            self.place[n] = often[slot].argmin()
            anchors.append(slot[self.place[n]])
            places.append(np.unique(np.append(np.arange(0, self.size[n] - _LONG, _LONG), self.size[n] - _LONG)))
            parts.append(code[places[-1]])
        count = np.bincount(np.array(anchors, np.int64), minlength=1 << _SLOT_BITS)
        self.slots, self.at_slot, self.of_slot = count.astype(np.int32), np.cumsum(count) - count, self.long[np.argsort(anchors, kind="stable")]
        self.n_parts = np.zeros(len(self.size), np.int64)
        self.n_parts[self.long] = [len(x) for x in parts]
        self.at_part = np.cumsum(self.n_parts) - self.n_parts
        self.part, self.part_place = np.concatenate(parts), np.concatenate(places)

    def found(self, texts: pa.Array) -> np.ndarray:
        """A line for each needle and a column for each text: whether it stands there."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        there = np.zeros((len(self.size) + 1, len(texts)), bool)
        if ends[-1] > ends[0]:
            data = np.frombuffer(texts.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
            ends = ends - ends[0]
            if self.long.size and self.slots is None:
                self._learn(data)
            for at in range(0, len(data), _WINDOW):
                self._look(data, ends, at, min(at + _WINDOW, len(data)), there)
        return there[1:]

    def _look(self, data: np.ndarray, ends: np.ndarray, begin: int, end: int, there: np.ndarray) -> None:
        """All needles that are looked up from places of one window."""
        text = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(np.clip(ends, begin, end)))
        code = np.zeros(end - begin, np.uint32)
        for k in range(_LONG):
            part = data[begin + k : end + k]
            code[: len(part)] |= part.astype(np.uint32) << np.uint32(8 * k)
        # What begins shortly before the end of a text would go on into the next.
        over = [x[(x >= begin) & (x < end)] - begin for x in (ends[1:] - k for k in range(1, _LONG))]
        for width, needle_of in self.short.items():
            needle = needle_of[code & np.uint32(256**width - 1)]
            for places in over[: width - 1]:
                needle[places] = 0
            hit = np.flatnonzero(needle)
            there[needle[hit], text[hit]] = True
        if self.long.size:
            slot = _slot(code)
            many = self.slots[slot]
            for places in over:
                many[places] = 0
            hit = np.flatnonzero(many)
            count = many[hit]
            pair = np.repeat(np.arange(len(hit)), count)
            within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            needle = self.of_slot[self.at_slot[slot[hit]][pair] + within]
            self._compare(data, ends, needle, text[hit][pair], hit[pair] + begin - self.place[needle], there)

    def _compare(self, data: np.ndarray, ends: np.ndarray, needle: np.ndarray, text: np.ndarray, start: np.ndarray, there: np.ndarray) -> None:
        """Needles against what stands at ``start``, four bytes after four."""
        same = (start >= ends[text]) & (start + self.size[needle] <= ends[text + 1])
        step = 0
        while same.any():
            needle, text, start = needle[same], text[same], start[same]
            k = self.at_part[needle] + step
            same = _codes(data, start + self.part_place[k], _LONG) == self.part[k]
            step += 1
            whole = same & (self.n_parts[needle] == step)
            there[needle[whole] + 1, text[whole]] = True
            same &= ~whole
