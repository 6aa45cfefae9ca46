"""Feature scores, final score, ranking and reasons."""

import random

import pytest
from pyspark.sql import functions as F

from dataclasses import replace

from rolecast.config import DEFAULT, Weights
from rolecast.operators import rank as R
from rolecast.operators.features import feature_table
from rolecast.operators.posting import Posting
from rolecast.operators.reason import add_reasoning
from rolecast.operators.score import add_final_score
from rolecast.operators.signal import add_signal_scores
from rolecast.plans import flow
from samples import HONEYPOT, SUSPICIOUS, VALID, load, profile, role, signals, skill

POSTING = Posting(skills=("Python", "SQL", "Spark"), skill_keys=("python", "sql", "spark"), min_years=5.0, industry="IT Services")


@pytest.mark.parametrize("sample,parts", [
    (VALID, (0.96, 0.409, 0.8767, 0.3566, 0.6875)),
    (HONEYPOT, (0.92, 0.96, 0.985, 0.77, 0.9225)),
    (SUSPICIOUS, (0.92, 0.47, 0.53, 0.1, 0.584)),
])
def test_signal_golden(spark, tmp_path, sample, parts):
    row = add_signal_scores(load(spark, tmp_path, sample)).first()
    got = [row[f"signal_{n}"] for n in ("availability", "responsiveness", "credibility", "market_demand", "score")]
    assert got == pytest.approx(parts, abs=1e-4)


def test_valid_profile_golden(spark, tmp_path):
    hits = load(spark, tmp_path, VALID).withColumn("semantic_score", F.lit(0.8))
    features = feature_table(hits, POSTING.criteria())
    row = features.first()
    assert (row["skill_score"], row["career_score"], row["signal_score"]) == pytest.approx((0.5729, 0.81, 0.6875), abs=1e-4)
    assert add_final_score(features).first()["final_score"] == pytest.approx(0.73358, abs=1e-4)
    narrow = features.select("candidate_id", "semantic_score", "skill_score", "career_score", "signal_score", "is_honeypot",
                             "open_to_work", "days_inactive", "interview_completion_rate")
    assert add_reasoning(narrow).first()["reasoning"] == (
        "Excellent profile-to-job semantic match, strong career progression, open to work.")


def test_malformed_row_scores_zero_but_is_screened(spark, tmp_path):
    bad = [profile("CAND_0000011", signals=signals(last_active_date="soon")), profile("CAND_0000012", years="x"),
           profile("CAND_0000013", career_history=[role(months="long")]),
           profile("CAND_0000014", skills=[skill("SQL", months="long")]), profile("CAND_0000015", skills=[skill("Cooking", months="long")])]
    rows = {r["candidate_id"]: r for r in feature_table(load(spark, tmp_path, *bad), POSTING.criteria()).collect()}
    for n in (11, 12, 13, 14):
        r = rows[f"CAND_00000{n}"]
        assert (r["scoring_error"], r["skill_score"], r["career_score"], r["signal_score"]) == (True, 0, 0, 0)
        assert (r["open_to_work"], r["days_inactive"], r["interview_completion_rate"]) == (True, 999, 1.0)
    assert rows["CAND_0000015"]["scoring_error"] is False  # an unmatched skill is never read
    assert rows["CAND_0000012"]["risk_score"] == 10


def test_zero_interview_rate(spark, tmp_path):
    df = load(spark, tmp_path, profile(signals=signals(interview_completion_rate=0)))
    assert feature_table(df, POSTING.criteria()).first()["interview_completion_rate"] == 1.0
    strict = replace(DEFAULT, zero_interview_is_missing=False)
    assert feature_table(df, POSTING.criteria(), strict).first()["interview_completion_rate"] == 0.0


def test_no_skills_wanted(spark, tmp_path):
    assert feature_table(load(spark, tmp_path, VALID), Posting().criteria()).first()["skill_score"] == 0.0


def test_weights_must_add_up():
    with pytest.raises(ValueError):
        Weights(semantic=0.5)


COLUMNS = ("candidate_id string, semantic_score double, skill_score double, career_score double, signal_score double, "
           "is_honeypot {b}, open_to_work {b}, days_inactive int, interview_completion_rate double")


def test_penalties_and_text_booleans(spark):
    rows = [("a", 1.0, 1.0, 1.0, 1.0, "False", "true", 180, 0.3), ("b", 1.0, 1.0, 1.0, 1.0, "yes", "true", 0, 1.0),
            ("c", 1.0, 1.0, 1.0, 1.0, None, "no", 181, 0.29), ("d", float("nan"), 1.0, float("inf"), None, "0", None, None, None)]
    got = {r[0]: r[1] for r in add_final_score(spark.createDataFrame(rows, COLUMNS.format(b="string"))).select("candidate_id", "final_score").collect()}
    assert got == pytest.approx({"a": 1.0, "b": 0.0, "c": 0.6 * 0.7 * 0.8, "d": 0.2})


def test_missing_columns_and_empty_input(spark):
    from rolecast.functions.scalars import require_nonempty

    with pytest.raises(KeyError, match="skill_score"):
        add_final_score(spark.createDataFrame([("a",)], "candidate_id string"))
    with pytest.raises(ValueError):
        require_nonempty(spark.range(0), "ranking")


def _scores(n, seed=3):
    rng = random.Random(seed)
    # A third of all rows share one score, another third one id.
    return [(f"CAND_{(7 if i % 3 == 1 else i):07d}", 0.0 if i % 3 == 0 else rng.choice([0.25, 0.5, rng.random()]), i) for i in range(n)]


def _expected(rows):
    first = {}
    for cid, score, i in rows:
        first.setdefault(cid, (cid, score, i))
    return [(c, s, n) for n, (c, s, _) in enumerate(sorted(first.values(), key=lambda r: (-r[1], r[0])), start=1)]


def test_rank_all_and_topk_against_sort(spark):
    rows = _scores(3000)
    df = spark.createDataFrame(rows, "candidate_id string, final_score double, ingest_ordinal long").repartition(7)
    want = _expected(rows)
    got = R.rank_all(df).select("candidate_id", "final_score", "rank").orderBy("rank").collect()
    assert [tuple(r) for r in got] == want
    top = R.rank_topk(df, 100).select("candidate_id", "final_score", "rank").orderBy("rank").collect()
    assert [tuple(r) for r in top] == want[:100]
    edges = R.rank_summary(R.rank_topk(df, 50)).orderBy("rank").collect()
    assert [r["rank"] for r in edges] == [1, 2, 3, 4, 5, 46, 47, 48, 49, 50]


def test_positions_of_identical_rows(spark):
    from rolecast.operators.ordered import with_rank

    df = spark.createDataFrame([("x", 0.5)] * 400 + [("y", 0.9)], "candidate_id string, final_score double").repartition(5)
    got = sorted((r["rank"], r["candidate_id"]) for r in with_rank(df, R.rank_order()).collect())
    assert got == [(1, "y")] + [(n, "x") for n in range(2, 402)]
    assert [(r["rank"], r["candidate_id"]) for r in R.rank_all(df).orderBy("rank").collect()] == [(1, "y"), (2, "x")]


def test_first_row_in_the_file_is_kept(spark, tmp_path):
    (tmp_path / "s.csv").write_text("candidate_id,final_score\n" + "".join(f"c{i % 3},{i / 10}\n" for i in range(9)))
    rows = flow.load_and_rank(spark, str(tmp_path / "s.csv")).orderBy("rank").collect()
    assert [(r["candidate_id"], r["final_score"]) for r in rows] == [("c2", 0.2), ("c1", 0.1), ("c0", 0.0)]


def test_fewer_rows_than_k(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "candidate_id string, final_score double")
    assert [(r["candidate_id"], r["rank"]) for r in R.rank_topk(df, 100).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_scores_stay_in_bounds(spark, tmp_path):
    from test_screen import CASES

    df = load(spark, tmp_path, *[c[0] for c in CASES.values()]).withColumn("semantic_score", F.lit(1.0))
    for r in add_final_score(feature_table(df, POSTING.criteria())).collect():
        assert all(0 <= r[c] <= 1 for c in ("skill_score", "career_score", "signal_score", "final_score"))
    ranked = flow.build_ranking(feature_table(df, POSTING.criteria()), 20).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:]))


def test_reason_details(spark):
    df = spark.createDataFrame(
        [("a", ["Python", "", "SQL", "Go", "C", "R"], 4.9, 0.125, True, 181), ("b", [], 0.4, 0.3, None, 180), ("c", None, None, None, None, None)],
        "candidate_id string, skills array<string>, years_experience double, interview_completion_rate double, open_to_work boolean, days_inactive int")
    got = {r["candidate_id"]: r["reasoning"] for r in add_reasoning(df).collect()}
    assert got["a"] == ("Strong Python, SQL, Go, C (+1 more) background, 4 years experience (early career), open to work, "
                        "inactive for 181 days (penalty applied), low interview completion rate (12%, penalty applied).")
    assert got["b"] == "" and got["c"] == ""
