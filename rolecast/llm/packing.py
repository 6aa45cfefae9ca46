"""Best-fit packing of documents into sequences of bounded length.

Lengths are whole numbers up to the capacity, so the instance is its histogram: at most
``capacity`` counts however many documents there are. The reduction and the best-fit rule
work on the histogram and yield runs ("the next 40 pieces of length 300 go, two each,
into sequences 17 to 36 at place 12"); Spark counts the pieces, ranks them within
their length and looks their places up in the runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecast.llm.common import slices, written
from rolecast.llm.tokens import text_encoder
from rolecast.llm.wordwise import row_bytes

CAPACITY = 1024
GROUP_ROWS = 256


class Run(NamedTuple):
    """Pieces ``rank .. rank + bins * each - 1`` of one length, ``each`` to a sequence."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    place: int


def _smallest(counts: np.ndarray, n: int) -> list[int]:
    found: list[int] = []
    for size in np.flatnonzero(counts > 0)[:n]:
        found += [int(size)] * int(min(counts[size], n - len(found)))
        if len(found) >= n:
            break
    return found


def _best_pair(counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two items with the largest sum within ``room``, larger one first; ties: larger first item."""
    sizes = np.flatnonzero(counts[: room + 1] > 0)
    best, low, high = None, 0, len(sizes) - 1
    while low <= high:
        a, b = int(sizes[high]), int(sizes[low])
        if a + b > room:
            high -= 1
            continue
        if low < high or counts[a] > 1:
            if best is None or (a + b, a) > (sum(best), best[0]):
                best = (a, b)
        low += 1
    return best


def dominating_set(counts: np.ndarray, item: int, capacity: int) -> list[int] | None:
    """A set with ``item`` that some best packing holds, by the Martello-Toth criteria, or None.

    Let the other items be sorted. If none fits beside the item, it is alone. If only one
    can, or the largest that fits leaves no room, the largest that fits goes with it. If
    two can but never three, the largest one dominates when no two have a larger sum, and
    the fullest pair does when it holds that largest one and every feasible pair lies
    below it item by item.
    """
    rest = counts.copy()
    rest[item] -= 1
    room = capacity - item
    small = _smallest(rest, 3)
    if not small or small[0] > room:
        return [item]
    one = int(np.flatnonzero(rest[: room + 1] > 0)[-1])
    if one == room or len(small) < 2 or small[0] + small[1] > room:
        return [item, one]
    if len(small) == 3 and sum(small) <= room:
        return None
    pair = _best_pair(rest, room)
    if pair is None or one >= sum(pair):
        return [item, one]
    if one == pair[0]:
        between = rest.copy()
        between[pair[0]] -= 1
        between[: pair[1] + 1] = 0
        above = _smallest(between, 2)
        larger = [*above[:1], pair[0]] if above else []
        if (len(above) < 2 or sum(above) > room) and (not larger or sum(larger) > room):
            return [item, *pair]
    return None


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Places of all pieces: fixed dominating sets first, best fit in falling order for the rest.

    Equal steps are taken together, as long as the classes of a set keep at least four
    more pieces, for the criteria look at three others at most. So the work depends on
    the capacity and not on the number of pieces.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit into {capacity}")
        counts[size] = n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    opened = 0

    def put(size: int, bins: int, each: int, sequence: int, place: int) -> None:
        runs.append(Run(size, int(used[size]), bins, each, sequence, place))
        used[size] += bins * each
        counts[size] -= bins * each

    for size in range(capacity, 0, -1):
        while counts[size] > 0 and (chosen := dominating_set(counts, size, capacity)) is not None:
            need = {x: chosen.count(x) for x in chosen}
            times = int(counts[size]) if len(chosen) == 1 and size * 2 > capacity else max(1, min((int(counts[x]) - 4) // n for x, n in need.items()))
            place = 0
            for x, n in need.items():
                put(x, times, n, opened, place)
                place += x * n
            opened += times
    room: dict[int, list[tuple[int, int]]] = {}
    for size in range(capacity, 0, -1):
        while counts[size] > 0:
            fits = min((r for r, bins in room.items() if r >= size and bins), default=0)
            if fits:
                first, n = room[fits].pop()
            else:
                fits, first, n = capacity, opened, max(1, int(counts[size]) // (capacity // size))
                opened += n
            each = min(fits // size, int(counts[size]))
            take = min(n, int(counts[size]) // each)
            put(size, take, each, first, capacity - fits)
            room.setdefault(fits - size * each, []).append((first, take))
            if take < n:
                room.setdefault(fits, []).append((first + take, n - take))
    return runs


def cut_documents(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of whole documents: ``(key, piece, start, length, ids)``.

    Documents up to the capacity are one piece; of longer ones all pieces but the first have
    the full length. ``ids`` are little-endian unsigned 32-bit integers. NULL and
    empty texts hold the end id alone (no piece if there is none). A row without a key and
    repeated rows are packed like any other; other columns are ignored.
    """
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    kind = docs.select(key).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer).column
        for batch in batches:
            for first, count in slices(batch.column(1), 4 << 20):
                rows, piece, start, length, data = [], [], [], [], []
                for k, ids in enumerate(row_bytes(*encode(batch.column(1).slice(first, count)), tail), first):
                    n, at, nr = len(ids) // 4, 0, 0
                    while at < n:
                        to = at + (n % capacity or capacity) if at == 0 else at + capacity
                        rows.append(k)
                        piece.append(nr)
                        start.append(at)
                        length.append(to - at)
                        data.append(ids[at * 4 : to * 4])
                        at, nr = to, nr + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())],
                    names=[key, "piece", "start", "length", "ids"],
                )

    return docs.select(key, text).mapInArrow(cut, f"{key} {kind}, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", piece: str = "piece", length: str = "length") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``.

    The pieces are saved first. Their lengths are counted by Spark; the counts (one row per
    length, ``capacity`` at most) come to the driver and become runs. To rank the pieces of one length
    without gathering them in one task, they are dealt into hash groups of about 256 rows or
    the square root of their number, ranked there, and shifted by the sizes of the groups before.
    An empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    counted = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    by_length: dict[int, list[Run]] = {}
    for run in plan_runs(counted, capacity):
        by_length.setdefault(run.length, []).append(run)
    lanes = [(n, max(1, int(c // max(GROUP_ROWS, c**0.5))), [tuple(r[1:]) for r in by_length[n]]) for n, c in counted.items()]
    # One row for each length, so bounded by the capacity.
    table = F.broadcast(spark.createDataFrame(
        lanes, "_length long, _lanes long, _runs array<struct<rank: long, bins: long, each: long, sequence: long, place: long>>"
    ).coalesce(1))
    dealt = (
        pieces.join(table.select("_length", "_lanes"), F.col(length) == F.col("_length"))
        .withColumn("_lane", F.pmod(F.xxhash64(key, piece), F.col("_lanes"))).drop("_lanes")
        .withColumn("_nr", F.row_number().over(W.partitionBy("_length", "_lane").orderBy(key, piece)))
    )
    sizes = pieces.join(table.select("_length", "_lanes"), F.col(length) == F.col("_length")).groupBy(
        "_length", F.pmod(F.xxhash64(key, piece), F.col("_lanes")).alias("_lane")).count()
    before = sizes.select("_length", "_lane", (F.sum("count").over(W.partitionBy("_length").orderBy("_lane")) - F.col("count")).alias("_before"))
    ranked = dealt.join(before, ["_length", "_lane"]).withColumn("_rank", F.col("_before") + F.col("_nr") - 1)
    run = F.filter("_runs", lambda r: (r.rank <= F.col("_rank")) & (F.col("_rank") < r.rank + r.bins * r.each))[0]
    at = F.col("_rank") - F.col("_run.rank")
    return (
        ranked.join(table.select(F.col("_length").alias("_l"), "_runs"), F.col("_length") == F.col("_l"))
        .withColumn("_run", run)
        .withColumn("sequence_id", F.col("_run.sequence") + F.floor(at / F.col("_run.each")))
        .withColumn("offset", F.col("_run.place") + (at % F.col("_run.each")) * F.col(length))
        .select(*pieces.columns, "sequence_id", "offset")
    )
