"""Stores that are read in part, and the merge of what tasks keep."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecast.operators import retrieve as R
from rolecast.operators import vector_store as VS
from rolecast.sources import profiles as SP


def scans(frame):
    """(rows read) of each file scan of a frame that has run."""
    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            yield from walk(node.executedPlan())
            return
        if kind.endswith("QueryStageExec"):
            yield from walk(node.plan())
            return
        if kind == "FileSourceScanExec":
            yield node.metrics().apply("numOutputRows").value()
        children = node.children()
        for k in range(children.size()):
            yield from walk(children.apply(k))

    return list(walk(frame._jdf.queryExecution().executedPlan()))


# -- profiles -------------------------------------------------------------------

@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "p")
    noise = F.sha2(F.col("id").cast("string"), 512)
    rows = spark.range(60_000).select(F.when(F.col("id") % 5_000 == 1, None).otherwise(F.format_string("CAND_%07d", F.col("id") * 7 % 60_000)).alias("candidate_id"), "id", F.concat(noise, noise).alias("body"))
    rows = rows.unionByName(rows.where("id = 70").select("candidate_id", F.lit(-1).cast("long").alias("id"), "body"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    SP.write_profile_store(rows, path, row_group_bytes=256 << 10)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path


def hits(spark, ids):
    return spark.createDataFrame([(i, float(k)) for k, i in enumerate(ids)], "candidate_id string, semantic_score double")


def test_few_ids_touch_few_row_groups(spark, store):
    near = hits(spark, [f"CAND_{k:07d}" for k in range(30_000, 30_100)])
    found = R.fetch_from_store(spark, store, near)
    rows = found.collect()
    assert 0 < sum(scans(found)) < 6_000
    joined = R.fetch_from_store(spark, store, near, most=5)
    assert len(joined.collect()) == len(rows) >= 99 and sum(scans(joined)) >= 60_000


def test_the_store_gives_the_rows_of_a_join(spark, store):
    draw = random.Random(2)
    wanted = hits(spark, [None, "CAND_0000490", "CAND_0000490", "nobody", *[f"CAND_{draw.randrange(70_000):07d}" for _ in range(60)]])
    for most in (2_000, 3):
        found = R.fetch_from_store(spark, store, wanted, most=most)
        want = R.fetch_by_ids(spark.read.parquet(store), wanted)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.where("candidate_id is null").count() == 12
    assert R.fetch_from_store(spark, store, wanted.where("false")).count() == 0
    assert R.fetch_from_store(spark, store, wanted).where("candidate_id = 'CAND_0000490'").count() == 2


def test_repeated_hits_keep_one_row_together(spark):
    frame = spark.createDataFrame([("A", 1)], "candidate_id string, x int")
    two = spark.createDataFrame([("A", 0.5, 1), ("A", 0.2, 9), (None, 0.1, 0)], "candidate_id string, score double, place int")
    assert [tuple(r) for r in R.fetch_by_ids(frame, two).select("candidate_id", "x", "score", "place").collect()] == [("A", 1, 0.5, 1)]


# -- vectors ---------------------------------------------------------------------

def clustered(n=3_000, dims=16, centres=25, seed=3):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, dims)) * 4
    rows = middle[draw.integers(centres, size=n)] + draw.normal(size=(n, dims)) * 0.3
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[::3] = rows[0]  # a third of the rows are copies of one vector
    rows[5] = 0
    return [f"CAND_{k:07d}" for k in draw.permutation(n)], rows


@pytest.fixture(scope="module")
def vector_store(spark, tmp_path_factory):
    ids, rows = clustered()
    path = str(tmp_path_factory.mktemp("vectors") / "v")
    frame = spark.createDataFrame([*[(i, r.tolist()) for i, r in zip(ids, rows)], (None, rows[1].tolist()), ("short", [1.0]), ("nan", [float("nan")] * 16)], "candidate_id string, embedding array<double>")
    VS.write_vector_store(frame.repartition(5), path, 16, block_rows=60)
    return path, frame, ids, rows


def brute(ids, rows, query, k):
    unit = query / (np.linalg.norm(query) or 1)
    scores = (rows * unit).sum(axis=1)
    order = np.lexsort((np.array(ids), -scores))[:k]
    return [(ids[o], scores[o]) for o in order]


@pytest.mark.parametrize("k", [1, 10, 500])
def test_skipped_blocks_change_nothing(spark, vector_store, k):
    path, frame, ids, rows = vector_store
    queries = np.vstack([rows[0], rows[7], rows[8] * 3, np.random.default_rng(1).normal(size=16), np.zeros(16)])
    names = [f"q{j}" for j in range(len(queries))]
    found, report = VS.stored_topk(spark, path, names, queries, k)
    by = {n: [(r.candidate_id, r.similarity) for r in found.where(F.col("posting_id") == n).orderBy("position").collect()] for n in names}
    full = R.similar_topk(frame, names, queries, k)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, full.select(*found.columns).collect()))
    for name, query in zip(names, queries):
        want = brute(ids, rows, query, k)
        assert [i for i, _ in by[name]] == [i for i, _ in want]
        assert np.allclose([s for _, s in by[name]], [s for _, s in want], atol=1e-12)
    assert report["blocks"] > 40
    _, alone = VS.stored_topk(spark, path, ["q"], rows[7][None], k)
    if k <= 10:
        assert alone["read"] < report["blocks"] / 4


def test_copies_are_split_and_bounds_hold(spark, vector_store):
    path, _, ids, rows = vector_store
    stored = spark.read.parquet(f"{path}/rows").toPandas()
    assert stored.groupby("block").size().max() < 200 and len(stored) == len(ids)
    bounds = spark.read.parquet(f"{path}/blocks").toPandas().set_index("block")
    for block, part in stored.groupby("block"):
        far = np.linalg.norm(np.stack(part.embedding) - np.array(bounds.loc[str(block)].centre), axis=1)
        assert far.max() <= bounds.loc[str(block)].radius + 1e-9 and len(part) == bounds.loc[str(block)].n


def test_empty_vector_store(spark, tmp_path):
    nothing = spark.createDataFrame([], "candidate_id string, embedding array<double>")
    VS.write_vector_store(nothing, str(tmp_path / "v"), 4)
    found, report = VS.stored_topk(spark, str(tmp_path / "v"), ["q"], np.ones((1, 4)), 3)
    assert found.count() == 0 and report == {"blocks": 0, "read": 0}


# -- merging ---------------------------------------------------------------------

def test_lanes_merge_to_the_best(spark):
    draw = random.Random(7)
    rows = [(f"q{draw.randrange(3)}", f"i{k}", draw.randrange(40) / 10, draw.randrange(10_000)) for k in range(5_000)]
    frame = spark.createDataFrame(rows, "posting_id string, candidate_id string, similarity double, _lane long")
    found = R.best_of_lanes(frame, ["posting_id"], [F.desc("similarity"), F.asc("candidate_id")], 7)
    for q in ("q0", "q1", "q2"):
        want = sorted((-s, i) for p, i, s, _ in rows if p == q)[:7]
        assert [(-r.similarity, r.candidate_id) for r in found.where(F.col("posting_id") == q).orderBy("position").collect()] == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") >= 3 and "_lane" in plan


def test_best_rows_do_not_depend_on_batches():
    ids, rows = clustered(400)
    queries = np.random.default_rng(3).normal(size=(6, 16))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    for size in (1, 7, 400):
        for places in (None, 3):
            best = R.TopRows(queries, 9, places)
            for at in range(0, 400, size):
                best.add(np.array(ids[at : at + size]), rows[at : at + size])
            for q in range(6):
                scores = (rows * queries[q]).sum(axis=1)
                scores = scores if places is None else np.round(scores, places)
                order = np.lexsort((np.array(ids), -scores))[:9]
                assert list(best.ids[best.query == q]) == [ids[o] for o in order] and (best.score[best.query == q] == scores[order]).all()
