"""Near-duplicate vectors on an inverted multi-index.

Unit vectors are cut in halves; each half has a codebook, and the pair of nearest codes is a
vector's cell on the product grid. Around a vector, cells are visited in the order of
their distance, the sum of the two halves' distances (multi-sequence
traversal): for a half, the squared distance to the plane between its own code and the
other one. The traversal of a region (all cells with one code of the first half) ends at the distance that reached the target recall there: it is
calibrated on the sample, both by its own links and by neighbours drawn at exactly the threshold around
every sampled vector, so that regions without links and tables whose links are rare have a bound too. A link of cosine ``c`` never needs
more than ``2 - 2c``, which is the bound for a target recall of 1. Visited cells are then compared exactly, in double precision.

Neighbouring cells are one group until they hold a block of rows. A vector goes once to each group with a
cell that it visits, so its copies are bounded by the groups and not by the visited cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import written
from rolecast.llm.components import components

#: The grid grows with the table: a cell holds about so many rows, within the least and most codes of a half.
ROWS_PER_CELL = 48
LEAST_CODES, MOST_CODES = 4, 512
SAMPLE_ROWS = 8_192
TARGET_RECALL = 0.9995
DRAWS = 24
CELL_ROWS = 1_024
VISIT_ROWS = 4_096


@dataclass
class MultiIndex:
    """Codebooks of both halves, with the bound of the traversal for each code of the first half."""

    books: tuple[np.ndarray, np.ndarray]
    bounds: np.ndarray

    def distances(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: own code, and the squared distance to the edge of each other code's region."""
        out = []
        half = unit.shape[1] // 2
        for book, part in zip(self.books, (unit[:, :half], unit[:, half:])):
            far = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            own = far.argmin(1)
            apart = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 0))[own]
            gap = far - far[np.arange(len(own)), own][:, None]
            out.append((own, np.where(apart > 0, np.divide(gap, 2 * apart, out=np.zeros_like(gap), where=apart > 0), 0) ** 2))
        return out

    def visits(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Home cell and visited cells of each vector."""
        (one, far1), (two, far2) = self.distances(unit)
        limits = self.bounds[one] + 1e-9
        n2 = len(self.books[1])
        for k in range(len(unit)):
            cells = []
            for far in (far1, far2):
                near = np.flatnonzero(far[k] <= limits[k])
                cells.append(near[np.argsort(far[k, near], kind="stable")])
            i, j = multi_sequence(far1[k, cells[0]], far2[k, cells[1]], limits[k])
            yield int(one[k]) * n2 + int(two[k]), cells[0][i] * n2 + cells[1][j]


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in two sorted sequences by rising sum of distances, up to ``limit``.

    For each place of the first sequence, the second one is taken as far as the limit lets it.
    """
    far = np.searchsorted(second, limit - first, side="right")
    i = np.repeat(np.arange(len(first)), far)
    j = np.arange(far.sum()) - np.repeat(np.cumsum(far) - far, far)
    order = np.argsort(first[i] + second[j], kind="stable")
    return i[order], j[order]


def _codebook(points: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    points = np.unique(points, axis=0)
    if len(points) <= codes:
        return points
    book = points[np.linspace(0, len(points) - 1, codes).astype(int)]
    for _ in range(rounds):
        own = ((book**2).sum(1) - 2 * points @ book.T).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=codes)
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return np.unique(book, axis=0)


def neighbours_at(unit: np.ndarray, threshold: float, draw: np.random.Generator) -> np.ndarray:
    """For each row a random unit vector whose cosine with it is the threshold."""
    other = draw.normal(size=unit.shape)
    other -= (other * unit).sum(1, keepdims=True) * unit
    length = np.linalg.norm(other, axis=1, keepdims=True)
    other = np.divide(other, length, out=np.zeros_like(other), where=length > 0)
    return threshold * unit + np.sqrt(max(0.0, 1 - threshold**2)) * other


def fit_index(sample: np.ndarray, threshold: float, target_recall: float = 1.0, codes: int = 32, seed: int = 5) -> MultiIndex:
    """Codebooks by k-means on a sample of unit vectors, and the bounds of the traversal by region.

    The bound of a region is the larger one of what its sampled vectors needed for their own links, every vector counted
    once, and of what they needed for neighbours drawn at the threshold, at the target recall; half as much again is
    added for rows outside the sample.
    """
    half = sample.shape[1] // 2
    books = (_codebook(sample[:, :half], codes), _codebook(sample[:, half:], codes))
    most = 2 - 2 * threshold
    index = MultiIndex(books, np.full(len(books[0]), most))
    if target_recall >= 1:
        return index
    (one, far1), (two, far2) = index.distances(sample)
    linked = np.full(len(sample), -1.0)
    for at in range(0, len(sample), 512):
        a, b = np.nonzero(sample[at : at + 512] @ sample.T >= threshold)
        a, b = a[a + at != b] + at, b[a + at != b]
        np.maximum.at(linked, a, far1[a, one[b]] + far2[a, two[b]])
    draw = np.random.default_rng(seed)
    drawn = np.zeros((len(sample), DRAWS))
    for k in range(DRAWS):
        (there1, _), (there2, _) = index.distances(neighbours_at(sample, threshold, draw))
        rows = np.arange(len(sample))
        drawn[:, k] = far1[rows, there1] + far2[rows, there2]
    everywhere = float(np.quantile(drawn, target_recall, method="higher"))
    for code in range(len(books[0])):
        here = one == code
        found = [everywhere]
        if here.any():
            found.append(float(np.quantile(drawn[here], target_recall, method="higher")))
        if (linked[here] >= 0).any():
            found.append(float(linked[here].max()))
        index.bounds[code] = min(most, 1.5 * max(found))
    return index


def codes_for(n: int) -> int:
    return int(min(MOST_CODES, max(LEAST_CODES, round((n / ROWS_PER_CELL) ** 0.5))))


def cell_groups(sizes: dict[int, int], cells: int, most: int) -> np.ndarray:
    """The group of each cell: neighbouring cells together hold ``most`` rows or less; a larger cell is a group."""
    group, held, at = np.zeros(cells, np.int64), 0, 0
    for cell in range(cells):
        n = sizes.get(cell, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        group[cell], held = at, held + n
    return group


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compare(ids: np.ndarray, role: np.ndarray, weight: np.ndarray, vectors: np.ndarray, threshold: float) -> tuple[pa.RecordBatch, ...]:
    """Linked rows of each visitor in a block of a cell, and a forest of these links."""
    base = role == 0
    home, visitor = ids[base], ids[~base]
    near = _unit(vectors[~base]) @ _unit(vectors[base]).T >= threshold
    count = near @ weight[base]
    rows, cols = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    near, visitor_all, visitor, home = near[np.ix_(rows, cols)], visitor, visitor[rows], home[cols]
    label = np.arange(len(cols))
    while len(cols):
        top = np.where(near, label[None, :], len(cols)).min(1)
        new = np.minimum(label, np.where(near, top[:, None], len(cols)).min(0))
        if (new == label).all():
            break
        label = new
    ends = (np.concatenate([visitor, home]), np.concatenate([home[top], home[label]])) if len(cols) else (home, home)
    apart = ends[0] != ends[1]
    got = count > 0
    n = int(got.sum()) + int(apart.sum())
    links = np.concatenate([count[got], np.zeros(int(apart.sum()), np.int64)])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([visitor_all[got], ends[0][apart]])), pa.array(np.concatenate([np.zeros(int(got.sum()), np.int64), ends[1][apart]]), mask=np.arange(n) < int(got.sum())), pa.array(links)],
        names=["rep", "other", "links"],
    )


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, target_recall: float = TARGET_RECALL, codes: int | None = None, sample_rows: int = SAMPLE_ROWS,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``(key, n_links, component_id, kept)``, one row per vector.

    Rows link when their cosine is at least ``threshold``; a target recall of 1 finds every link, a lower one is
    measured in the README. Identical vectors are one class with a
    weight; each class visits cells, and the classes of a group of cells are dealt into blocks of bounded size
    that meet its visitors in blocks, so a dense cell is many tasks. A block gives one
    row per visitor with its number of links, and a forest of links. The codebooks are
    fitted on the ``sample_rows`` classes with the smallest hash of their key and grow with the number of classes (``codes`` fixes
    them); every row is indexed. Vectors of equal length are compared with each other, each length in an index of its own.
    Vectors that are NULL, zero, or that hold NULL or non-finite numbers link with nothing, as do rows without a key (their
    ``component_id`` is NULL). Repeated rows count as other vectors of one key. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)
    usable = rows.where(good)
    classes = written(usable.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    met = None
    # A length with a single class has no other links than those of its copies.
    for dims, n in sorted(tuple(r) for r in classes.groupBy(F.size("v").alias("d")).count().where("count > 1").collect()):
        found = _links(classes.where(F.size("v") == dims), threshold, target_recall, codes or codes_for(n), sample_rows)
        met = found if met is None else met.unionByName(found)
    if met is None:
        named = classes.select("v", (F.col("n") - 1).alias("links"), F.col("rep").alias("component"))
    else:
        joined = components(met.where("other is not null"), "rep", "other", "near-vectors")
        counts = met.where("other is null").groupBy("rep").agg((F.sum("links") - 1).alias("links"))
        named = classes.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select(
            "v", F.coalesce("links", F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    member = usable.select("id", "v").join(named, "v").select("id", "links", "component")
    alone = rows.where(~F.coalesce(good, F.lit(False)))
    every_row = member.unionByName(alone.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component")))
    return every_row.select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def _links(classes: DataFrame, threshold: float, target_recall: float, codes: int, sample_rows: int) -> DataFrame:
    """``(rep, other, links)`` of classes of one length: rows without ``other`` count links, the others are a forest of them. Saved."""
    spark = classes.sparkSession
    found = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("v").toPandas()["v"]
    index = spark.sparkContext.broadcast(fit_index(_unit(np.stack(found)), threshold, target_recall, codes))

    cells = len(index.value.books[0]) * len(index.value.books[1])

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.zeros(cells, np.int64)
            for at in range(0, batch.num_rows, 2048):
                (one, _), (two, _) = index.value.distances(_unit(_matrix(batch.column(0).slice(at, 2048))))
                held += np.bincount(one * len(index.value.books[1]) + two, minlength=cells)
            got = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int32()), pa.array(held[got], pa.int64())], names=["cell", "n"])

    # One row for each cell of the grid: codes * codes at most.
    held = {r.cell: r.n for r in classes.select("v").mapInArrow(home, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    group_of = spark.sparkContext.broadcast(cell_groups(held, cells, CELL_ROWS))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, seen = [], []
                for cell, visited in index.value.visits(_unit(_matrix(part.column(2)))):
                    own.append(int(group_of.value[cell]))
                    seen.append(np.unique(group_of.value[visited]).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(seen, pa.list_(pa.int32())), *part.columns], names=["own", "seen", "rep", "n", "v"])

    kind = classes.schema["v"].dataType.simpleString()
    stored = written(classes.select("rep", "n", "v").mapInArrow(visit, f"own int, seen array<int>, rep long, n long, v {kind}"), "visited-cells")
    homes = stored.select(F.col("own").alias("cell"), F.lit(0).alias("role"), "rep", "n", "v")
    guests = stored.select(F.explode("seen").alias("cell"), F.lit(1).alias("role"), "rep", "n", "v")
    counted = stored.select(F.col("own").alias("cell"), F.lit(0).alias("role")).unionByName(stored.select(F.explode("seen").alias("cell"), F.lit(1).alias("role")))
    sizes = counted.groupBy("cell").agg(
        F.ceil(F.sum(1 - F.col("role")) / CELL_ROWS).cast("int").alias("bases"), F.ceil(F.sum("role") / VISIT_ROWS).cast("int").alias("visits")
    ).where("bases > 0 and visits > 0")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    base = homes.join(F.broadcast(sizes), "cell").select("cell", own("bases").alias("b"), F.explode(every("visits")).alias("q"), "role", "rep", "n", "v")
    guest = guests.join(F.broadcast(sizes), "cell").select("cell", F.explode(every("bases")).alias("b"), own("visits").alias("q"), "role", "rep", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        current = None

        def answer() -> Iterator[pa.RecordBatch]:
            role, ids, weight, rows = (np.concatenate(x) for x in zip(*held))
            if (role == 0).any() and (role == 1).any():
                yield _compare(ids, role, weight, rows, threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1), batch.num_rows]
            role, ids, weight, rows = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(6))
            for a, b in zip(cuts, cuts[1:]):
                if current is not None and current != tuple(place[:, a]):
                    yield from answer()
                    held.clear()
                current = tuple(place[:, a])
                held.append((role[a:b], ids[a:b], weight[a:b], rows[a:b]))
        if held:
            yield from answer()

    laid = base.unionByName(guest).repartition("cell", "b", "q").sortWithinPartitions("cell", "b", "q", "role", "rep")
    return written(laid.mapInArrow(compare, "rep long, other long, links long"), "vector-links")
