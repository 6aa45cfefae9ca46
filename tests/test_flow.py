"""Files in, ranked file out."""

import json

import pytest

import rolecast as rc
from rolecast.operators import audit as A
from rolecast.plans import flow
from rolecast.sources import tables as ST
from samples import load, profile, signals, skill

JD = {"title": "Data Engineer", "required_skills": ["Spark", "Kafka"], "min_experience_years": 4, "industry": "Software",
      "description": "Spark and Kafka services"}


@pytest.fixture()
def files(tmp_path):
    people = [profile(f"CAND_{i:07d}", 4 + i % 5, headline="Spark engineer" if i % 2 else "Cook",
                      skills=[skill("Spark" if i % 2 else "Cooking", "expert", 5, 10 + i)],
                      signals=signals(saved_by_recruiters_30d=i % 20, last_active_date="2026-06-01")) for i in range(240)]
    people += [people[1], {**people[3], "skills": []}]  # copies: the first one counts
    (tmp_path / "people.jsonl").write_text("\n".join(json.dumps({("vendor_signals" if k == "signals" else k): v for k, v in p.items()}) for p in people) + "\nbroken\n")
    (tmp_path / "jd.json").write_text(json.dumps(JD))
    return tmp_path


@pytest.mark.parametrize("mode", ["keyword", "semantic"])
def test_whole_run(spark, files, mode):
    people, jd, out = str(files / "people.jsonl"), str(files / "jd.json"), str(files / "features.parquet")
    vectors = None
    if mode == "semantic":
        vectors = str(files / "vectors")
        rc.build_vectors(rc.read_profiles(spark, people, "vendor_signals"), vectors)
    features = rc.run_features(spark, people, jd, out, vectors, mode=mode, top_n=130, signals_field="vendor_signals")
    assert {"candidate_id", "semantic_score", "risk_score", "validation_tier", "skills"} <= set(features.columns)
    assert features.count() >= 120
    assert (features.where("semantic_score > 0").count() > 0) == (mode == "semantic")
    written = rc.build_and_write(features, str(files / "ranked"))
    rows = written.collect()
    assert len(rows) == 100 and all(int(r["candidate_id"][-1]) % 2 for r in rows)
    assert rc.audit(written, ST.csv_header(spark, str(files / "ranked"))).where("check NOT IN ('tiebreak')").count() == 0


def test_forced_semantic_without_vectors(spark, files):
    with pytest.raises(FileNotFoundError):
        rc.run_features(spark, str(files / "people.jsonl"), str(files / "jd.json"), str(files / "f"), mode="semantic", signals_field="vendor_signals")


def test_load_and_rank_and_narrow(spark, files):
    df = spark.createDataFrame([(f"CAND_{i % 50:07d}", (i * 37 % 101) / 101, i, "x" * 20) for i in range(200)],
                               "candidate_id string, final_score double, ingest_ordinal long, extra string")
    df.write.parquet(str(files / "scored.parquet"))
    wide = [tuple(r) for r in flow.load_and_rank(spark, str(files / "scored.parquet"), 10).select("rank", "candidate_id", "extra").orderBy("rank").collect()]
    narrow = [tuple(r) for r in rc.rank_topk_narrow(df, 10).select("rank", "candidate_id", "extra").orderBy("rank").collect()]
    assert wide == narrow and len(wide) == 10
    df.drop("ingest_ordinal", "extra").limit(3).write.option("header", True).csv(str(files / "s.csv"))
    assert flow.load_and_rank(spark, str(files / "s.csv")).count() == 3


def test_score_can_be_given(spark):
    df = spark.createDataFrame([("a", 1, 0.1234567, "r")], "candidate_id string, rank long, score double, reasoning string")
    assert rc.format_ranked(df).first()["score"] == 0.123457
    assert A.HEADER == tuple(rc.format_ranked(df).columns)


def test_many_postings_from_files(spark, files):
    """Every posting ranked as it would be alone."""
    from pyspark.sql import functions as F

    from rolecast.operators.posting import with_criteria
    from rolecast.sources.postings import with_defaults
    from rolecast.sources.tables import read_vectors

    profiles = rc.dedupe_first(rc.read_profiles(spark, str(files / "people.jsonl"), "vendor_signals"))
    rc.build_vectors(profiles, str(files / "vectors"))
    vectors = read_vectors(spark, str(files / "vectors"))
    wanted = []
    for i, (title, skills, years) in enumerate([("Cook", ["Cooking"], 3.0), ("Data Engineer", ["Spark", "SQL"], 6.0)]):
        frame = with_defaults(spark.createDataFrame([(title, skills, [], str(years), "Software", title)],
                              "title string, required_skills array<string>, preferred_skills array<string>, min_experience_years string, industry string, description string"))
        posting = rc.single_posting(frame)
        vector = flow.encode_posting(spark, posting)
        wanted.append((f"P{i}", posting, vector, frame.withColumns({"posting_id": F.lit(f"P{i}"), "embedding": F.array(*[F.lit(x) for x in vector])})))
    together = rc.rank_for_postings(profiles, vectors, wanted[0][3].unionByName(wanted[1][3]), top_n=40, top_k=15)
    got = {(r["posting_id"], r["rank"]): (r["candidate_id"], r["score"], r["reasoning"]) for r in together.collect()}
    assert len(got) == 30
    for name, posting, vector, _ in wanted:
        alone = rc.build_ranking(rc.retrieve_and_score(profiles, posting, vectors, vector, top_n=40), 15)
        assert {(name, r["rank"]): (r["candidate_id"], r["score"], r["reasoning"]) for r in alone.collect()} == {k: v for k, v in got.items() if k[0] == name}
    assert with_criteria(wanted[1][3]).first()["skill_keys"] == ["spark", "sql"]


def test_profiles_without_id_stay_apart(spark, tmp_path):
    from samples import VALID

    nameless = {k: v for k, v in VALID.items() if k != "candidate_id"}
    path = tmp_path / "n.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in (nameless, nameless, VALID)))
    ranked = rc.build_ranking(rc.feature_table(rc.read_profiles(spark, str(path)), rc.Posting().criteria()))
    ids = [r["candidate_id"] for r in ranked.collect()]
    assert len(ids) == len(set(ids)) == 3 and sum(i.startswith("UNKNOWN_") for i in ids) == 2


def test_missing_vectors_mean_keywords(spark, files):
    args = (spark, str(files / "people.jsonl"), str(files / "jd.json"))
    rows = rc.run_features(*args, str(files / "g"), vectors_path=str(files / "nothing"), signals_field="vendor_signals")
    assert rows.count() > 0 and rows.where("semantic_score <> 0").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        rc.run_features(*args, str(files / "h"), vectors_path=str(files / "nothing"), mode="semantic", signals_field="vendor_signals")


def test_ranking_per_posting_drops_repeats(spark):
    df = spark.createDataFrame([("P", "A", 0.9, 1), ("P", "A", 0.9, 2), ("P", "B", 0.5, 3), ("Q", "A", 0.1, 4)], "posting_id string, candidate_id string, final_score double, ingest_ordinal long")
    got = sorted((r["posting_id"], r["rank"], r["candidate_id"]) for r in rc.rank_topk(df, 5, by=["posting_id"]).collect())
    assert got == [("P", 1, "A"), ("P", 2, "B"), ("Q", 1, "A")]
