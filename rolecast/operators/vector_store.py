"""Vectors in blocks with bounds, and exact search that leaves blocks out.

Vectors are dealt to the nearest centre of a small codebook and stored in blocks. Each block has its centre and
radius on record. The product of a vector of a block with a query of length one is at most the centre's product plus
the radius, so a block whose bound is under the k-th best similarity found elsewhere is never read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators.encode import unit_rows
from rolecast.operators.retrieve import similar_topk, usable_vectors
from rolecast.session import scratch_path

SAMPLE = 20_000
CODES = 1_024
BLOCK_ROWS = 50_000
ROUNDS = 12
#: More than rounding can move a product of unit vectors.
SLACK = 1e-6


def fit_centres(sample: np.ndarray, codes: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds, begun at rows that are far from those taken before."""
    draw = np.random.default_rng(seed)
    centres = [sample[draw.integers(len(sample))]]
    far = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < min(codes, len(sample)) and far.max() > 0:
        centres.append(sample[int(draw.choice(len(sample), p=far / far.sum()))])
        far = np.minimum(far, ((sample - centres[-1]) ** 2).sum(axis=1))
    found = np.array(centres)
    for _ in range(rounds):
        near = nearest(sample, found)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(found))
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[np.argmax(rows[k : k + 4096] @ centres.T - half, axis=1) for k in range(0, len(rows), 4096)]])


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def write_vector_store(vectors: DataFrame, path: str, dims: int, key: str = "candidate_id", codes: int | None = None, block_rows: int = BLOCK_ROWS) -> None:
    """Store ``(key, embedding)`` as blocks below ``path/rows`` and their bounds in ``path/blocks``.

    The codebook is fitted on a sample of at most 20,000 rows, one centre for each ``block_rows`` rows and at
    most 1,024; every row is dealt. A centre with more rows than a block holds has several blocks, so a frequent vector does not make a
    large one. Rows that cannot be compared (see ``usable_vectors``) are left out.
    """
    spark = vectors.sparkSession
    rows = usable_vectors(vectors, dims, key).select(key, F.col("embedding").cast("array<double>").alias("embedding"))
    total = rows.count()
    if codes is None:
        codes = max(1, min(CODES, -(-total // block_rows)))
    # A sample by hash: the same rows whatever the partitions are.
    share = max(1, total // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).limit(SAMPLE).collect() if total else []
    sample = np.array([r[1] for r in some], np.float64) if some else np.zeros((1, dims))
    centres = fit_centres(sample, codes)
    kind = rows.schema[key].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(_rows(batch.column(1)), centres), pa.int32())], names=[key, "embedding", "code"])

    scratch = scratch_path(spark, "dealt-vectors")
    rows.mapInArrow(deal, f"{key} {kind}, embedding array<double>, code int").write.parquet(scratch)
    dealt = spark.read.parquet(scratch)
    sizes = {r[0]: r[1] for r in dealt.groupBy("code").count().collect()}  # one row for each centre
    splits = spark.createDataFrame([(c, -(-n // block_rows)) for c, n in sizes.items()], "code int, parts long").coalesce(1)
    block = F.format_string("%04d-%06d", F.col("code"), F.pmod(F.xxhash64(key, "nr"), F.col("parts")))
    blocked = dealt.withColumn("nr", F.monotonically_increasing_id()).join(F.broadcast(splits), "code").withColumn("block", block).drop("parts", "nr")
    # One block is one task's bounded share.
    blocked.repartition(F.col("block")).drop("code").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            unit = _rows(batch.column(1))
            code = np.array([int(n.split("-")[0]) for n in names], np.int64)
            far = np.sqrt(((unit - centres[code]) ** 2).sum(axis=1)) if names else np.zeros(0)
            best: dict[str, list] = {}
            for name, d in zip(names, far):
                held = best.setdefault(name, [0.0, 0])
                held[0], held[1] = max(held[0], float(d)), held[1] + 1
            yield pa.RecordBatch.from_pydict({"block": list(best), "radius": pa.array([b[0] for b in best.values()], pa.float64()), "n": pa.array([b[1] for b in best.values()], pa.int64())})

    made = (
        spark.read.parquet(f"{path}/rows").select(F.col("block").cast("string"), "embedding").mapInArrow(bounds, "block string, radius double, n long").groupBy("block").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))
        if total else spark.createDataFrame([], "block string, radius double, n long")
    )
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "code int, centre array<double>").coalesce(1)
    with_centre = made.withColumn("code", F.split("block", "-")[0].cast("int")).join(F.broadcast(table), "code", "left").drop("code")
    with_centre.coalesce(1).write.mode("overwrite").parquet(f"{path}/blocks")


def block_bounds(spark: SparkSession, path: str, unit: np.ndarray) -> DataFrame:
    """``(block, n, bound)``: the largest similarity that a row of a block can have to any of the queries' rows, one row for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centres = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bound = centres @ unit.T + batch.column(2).to_numpy()[:, None] * (1 + SLACK) + SLACK
            rows, queries = np.indices(bound.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(queries, pa.int32()), pa.array(bound.ravel())], names=["block", "n", "query", "bound"]
            )

    stored = spark.read.parquet(f"{path}/blocks").select("block", "n", "radius", "centre")
    return stored.mapInArrow(run, "block string, n long, query int, bound double")


def stored_topk(
    spark: SparkSession, path: str, query_ids: Sequence[str], queries: np.ndarray, k: int, key: str = "candidate_id", query_key: str = "posting_id", places: int | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """``similar_topk`` over a stored table, equal to a search of all rows, and how many blocks were read.

    First the most promising blocks of each query that hold k rows are searched. Their k-th best similarity is
    what a further block's bound must reach; the others are never opened. Queries go to every task.
    """
    unit = unit_rows(np.atleast_2d(np.asarray(queries, np.float64)))
    names = [str(q) for q in query_ids]
    kind = f"{query_key} string, {key} string, similarity double, position int"
    bounds = block_bounds(spark, path, unit)
    total = spark.read.parquet(f"{path}/blocks").count()
    if not total or not names:
        return spark.createDataFrame([], kind), {"blocks": total, "read": 0}
    rows = spark.read.parquet(f"{path}/rows").withColumn("block", F.col("block").cast("string"))
    before = "coalesce(sum(n) OVER (PARTITION BY query ORDER BY bound DESC, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    # One row for each block and query; the blocks to read are named by a broadcast list of at most all blocks.
    first = bounds.withColumn("before", F.expr(before)).where(F.col("before") < k).select("block").distinct()
    first_names = [r[0] for r in first.collect()]
    found = similar_topk(_of(rows, spark, first_names), names, unit, k, key, query_key, places)
    least = {r[0]: r[1] for r in found.where(F.col("position") == k).select(query_key, "similarity").collect()}
    margin = 0.0 if places is None else 10.0**-places
    floors = spark.createDataFrame([(q, least.get(name, -2.0) - margin) for q, name in enumerate(names)], "query int, least double").coalesce(1)
    needed = bounds.join(F.broadcast(floors), "query").where(F.col("bound") >= F.col("least")).select("block").distinct()
    everything = sorted({r[0] for r in needed.collect()} | set(first_names))
    result = similar_topk(_of(rows, spark, everything), names, unit, k, key, query_key, places)
    return result, {"blocks": total, "read": len(everything)}


def _of(rows: DataFrame, spark: SparkSession, blocks: list[str]) -> DataFrame:
    """The rows of some blocks: other folders are left out when the join's list is known."""
    if len(blocks) <= 1_000:
        return rows.where(F.col("block").isin(blocks)).drop("block")
    wanted = spark.createDataFrame([(b,) for b in blocks], "block string")
    return rows.join(F.broadcast(wanted), "block", "left_semi").drop("block")
