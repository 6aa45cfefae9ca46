"""Readers, writers, text building, retrieval and the audit."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataclasses import replace

from rolecast.config import DEFAULT, Retrieval
from rolecast.functions import scalars as C
from rolecast.functions import text as T
from rolecast.operators import audit as A
from rolecast.operators import encode as E
from rolecast.operators import retrieve as R
from rolecast.operators.posting import extract_fields
from rolecast.operators.screen import validate_batch
from rolecast.sources import postings as PS
from rolecast.sources import profiles as SP
from rolecast.sources import tables as ST
from samples import VALID, load, profile, skill


# -- JSON lines -------------------------------------------------------------

@pytest.fixture()
def broken_file(tmp_path):
    odd = profile("CAND_0000002", years="abc", skills=None, career_history=[None], certifications=None)
    lines = [json.dumps(VALID), "", "   ", '{"candidate_id": "CAND_00', "not json", json.dumps(odd), json.dumps({})]
    path = tmp_path / "in.jsonl"
    path.write_bytes("\n".join(lines).encode() + b"\n" + b'{"candidate_id": "CAND_\xff0001"}\n')
    return str(path)


def test_lenient_reader(spark, broken_file):
    rows = SP.read_profiles(spark, broken_file).orderBy("ingest_ordinal").collect()
    assert [r["candidate_id"] for r in rows[:3]] == ["CAND_0000001", "CAND_0000002", None] and len(rows) == 4
    assert rows[3]["candidate_id"] == "CAND_\ufffd0001"
    assert rows[1]["profile"]["years_of_experience"] == "abc"
    assert rows[1]["skills"] == [] and rows[1]["career_history"] == [] and rows[1]["certifications"] == []
    rejected = [r["line"] for r in SP.read_rejected(spark, broken_file).collect()]
    assert sorted(rejected) == sorted(['{"candidate_id": "CAND_00', "not json"])


def test_strict_reader(spark, broken_file, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        SP.read_profiles_strict(spark, broken_file).collect()
    good = tmp_path / "good.jsonl"
    good.write_text(json.dumps(VALID))
    assert SP.read_profiles_strict(spark, str(good)).count() == 1


def test_other_name_of_the_signals(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps({("platform_signals" if k == "signals" else k): v for k, v in VALID.items()}))
    assert SP.read_profiles(spark, str(path), "platform_signals").first()["signals"]["notice_period_days"] == "60"


def test_parquet_copy_prunes_nested_columns(spark, tmp_path):
    SP.write_profiles(load(spark, tmp_path, VALID, profile()).drop("ingest_ordinal"), str(tmp_path / "p"))
    df = SP.load_profiles(spark, str(tmp_path / "p")).select("candidate_id", "profile.headline")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "profile:struct<headline:string>" in plan and "summary" not in plan


def _parsed(spark, *lines):
    return SP.parse_profiles(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "ingest_ordinal long, value string"), note_odd=True).orderBy("ingest_ordinal")


def test_a_stray_element_costs_only_itself(spark):
    odd = {**VALID, "career_history": ["oops", VALID["career_history"][0], None, 7], "skills": [{"name": "SQL"}, ["x"]], "education": "none"}
    rows = _parsed(spark, json.dumps(odd), json.dumps(VALID), json.dumps({**VALID, "profile": [1], "certifications": [None]})).collect()
    assert [r["company"] for r in rows[0]["career_history"]] == ["Mindtree"] and [x["name"] for x in rows[0]["skills"]] == ["SQL"]
    assert rows[0]["odd_parts"] == ["career_history", "education", "skills"] and rows[0]["education"] == []
    assert rows[1]["odd_parts"] == [] and rows[2]["odd_parts"] == ["profile", "certifications"] and rows[2]["profile"] is None
    flags = {r["candidate_id"]: r["flags"] for r in validate_batch(_parsed(spark, json.dumps(odd)).drop("odd_parts")).collect()}
    assert "empty_career_history" not in flags["CAND_0000001"]


def test_only_whole_objects_are_lines(spark):
    whole = ['{"candidate_id":"x","candidate_id":"e"}', '  {"candidate_id":"f","profile":{"years_of_experience":NaN,"headline":"a: NaN, \\"q\\" -Infinity"}} ',
             '{"candidate_id":12,"x":-Infinity}', '{"candidate_id":"g","profile":{"headline":"{} ]"}}', "{}"]
    broken = ['{"candidate_id":"a"} trailing', '{"candidate_id":"b"}{"b":2}', '{"candidate_id":"c"},{"b":2}', '{"candidate_id":"d"}]', '{"candidate_id":"d"},0]', "[1]", '"x"', "null", "NaN",
              '{"candidate_id":NaNo}', "{'a':1}", '{"a":1,}', '{"candidate_id":"h"']
    rows = _parsed(spark, *whole, *broken).collect()
    assert [r["candidate_id"] for r in rows[:5]] == ["e", "f", "12", "g", None] and all(r["_corrupt_record"] is None for r in rows[:5])
    assert rows[1]["profile"]["years_of_experience"] == "NaN" and rows[1]["profile"]["headline"] == 'a: NaN, "q" -Infinity'
    assert [r["_corrupt_record"] for r in rows[5:]] == broken


# -- postings ---------------------------------------------------------------

TEXT = """Job Title: Senior Data Engineer
We need 4.5+ years of experience. Industry: AI/ML
Required skills:
- Python (3 years)
* Kafka streams
- far too many words in this one
Preferred: - Rust
"""


def test_text_posting(spark, tmp_path):
    path = tmp_path / "jd.txt"
    path.write_text(TEXT)
    p = PS.load_posting(spark, str(path))
    assert (p.title, p.min_years, p.industry) == ("Senior Data Engineer", 4.5, "AI/ML")
    assert "Python" in p.skills and "Kafka streams" in p.skills and "Kafka" in p.skills and "Rust" in p.skills
    assert "R" in p.skills  # a plain substring test
    assert len(set(p.skills)) == len(p.skills) and not any("far too many" in s for s in p.skills)
    whole = extract_fields(spark.createDataFrame([(TEXT,)], "text string"), word_boundary=True).first()
    assert "R" not in whole["required_skills"] and "Kafka" in whole["required_skills"]
    stem = PS.read_posting_text(spark, str(path)).first()
    assert stem["file_stem"] == "jd"


def test_json_posting_and_defaults(spark, tmp_path):
    path = tmp_path / "jd.json"
    path.write_text(json.dumps({"title": "X", "required_skills": ["C++", ""], "min_experience_years": None}, indent=1))
    p = PS.load_posting(spark, str(path))
    assert (p.title, p.skills, p.skill_keys, p.min_years, p.industry) == ("X", ("C++",), ("c",), 0.0, "")
    assert PS.load_posting(spark, str(tmp_path / "none.json")).skills == ()
    with pytest.raises(ValueError):
        PS.load_posting(spark, str(tmp_path / "jd.docx"))


# -- small functions --------------------------------------------------------

def test_text_functions(spark):
    df = spark.createDataFrame([("  C++ & Café\tX ",), ("a" * 30 + " " + "b" * 30,), ("x" * 60,)], "t string")
    clean = [r[0] for r in df.select(T.clean_text(F.col("t"))).collect()]
    assert clean[0] == "c caf x"
    cut = [r[0] for r in df.select(T.truncate_words(F.col("t"), 40)).collect()]
    assert cut[1] == "a" * 30 and cut[2] == "x" * 40


def test_blob_repeats_and_last_roles(spark, tmp_path):
    from samples import role

    p = profile(skills=[skill("Go!", "expert"), skill("SQL", "Expert"), skill("C", "advanced")],
                career_history=[role(f"Job{i}", description="", start=f"20{20 - i}-01-01") for i in range(5)])
    text = load(spark, tmp_path, p).select(T.candidate_text_blob().alias("t"), T.candidate_text_blob(by_start_date=True).alias("u")).first()
    assert " go go go sql c c " in text["t"] and "job2 job3 job4" in text["t"] and "job1" not in text["t"]
    assert "job2 job1 job0" in text["u"]


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-1-5", "3.7"), ("2024-02-30", "NaN"), ("2024", "Infinity"), (None, ""), ("24-01-01", "x")], "d string, n string")
    rows = df.select(C.parse_date(F.col("d")).cast("string"), C.safe_float(F.col("n"), 9.0), C.whole(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("2024-01-05", 3.7, 3), (None, 9.0, None), (None, 9.0, None), (None, 9.0, None), (None, 9.0, None)]


# -- vectors ----------------------------------------------------------------

def _vectors(spark, n=500, dims=24, parts=6):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(n, dims))
    m[::3] = m[0]  # a third of the rows are copies of one vector
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = [f"CAND_{i:07d}" for i in range(n)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "candidate_id string, embedding array<double>")
    return ids, m, df.repartition(parts)


def _brute(ids, m, q, k):
    s = np.round(m @ (q / np.linalg.norm(q)), 9)
    return [i for _, i in sorted(zip(-s, ids))][:k]


def test_topk_against_brute_force(spark):
    ids, m, df = _vectors(spark)
    q = m[0] * 3
    rows = R.cosine_topk(df, q, 40).orderBy("position").collect()
    assert [r["candidate_id"] for r in rows] == _brute(ids, m, q, 40)
    assert R.cosine_topk(df, q, 10_000).count() == len(ids)


def test_topk_per_posting_in_blocks(spark):
    ids, m, df = _vectors(spark)
    postings = spark.createDataFrame([(f"P{i}", m[i].tolist()) for i in range(20)], "posting_id string, embedding array<double>")
    small = replace(DEFAULT, retrieval=Retrieval(broadcast_bytes=24 * 8 * 6))
    for config in (DEFAULT, small):
        got = {}
        for r in R.cosine_topk_by_posting(df, postings, 7, config=config).orderBy("posting_id", "position").collect():
            got.setdefault(r["posting_id"], []).append(r["candidate_id"])
        assert got == {f"P{i}": _brute(ids, m, m[i], 7) for i in range(20)}


def test_semantic_scores_are_clipped(spark):
    ids, m, df = _vectors(spark)
    scores = [r["semantic_score"] for r in R.semantic_retrieve(df, m[1], len(ids)).collect()]
    assert min(scores) == 0.0 and max(scores) <= 1.0


def test_encoder(spark):
    texts = spark.createDataFrame([("a", "data data spark"), ("b", ""), ("c", "spark")], "candidate_id string, text string")
    made = []

    class Counting(E.HashingEncoder):
        def __call__(self, batch):
            assert len(batch) <= 2
            return super().__call__(batch)

    out = {r[0]: np.array(r[1]) for r in E.batch_embed(texts, lambda: Counting(32), batch_size=2).collect()}
    assert np.linalg.norm(out["a"]) == pytest.approx(1, abs=1e-6) and not out["b"].any() and len(out["c"]) == 32
    assert out["a"] @ out["c"] == pytest.approx(1 / 5**0.5, abs=1e-6) and not made


def test_modes():
    assert R.choose_mode("auto", True) == "semantic" and R.choose_mode("auto", False) == "keyword"
    with pytest.raises(FileNotFoundError):
        R.choose_mode("semantic", False)
    with pytest.raises(ValueError):
        R.choose_mode("fuzzy", True)


def test_keyword_topn(spark, tmp_path):
    people = [profile(f"CAND_{i:07d}", headline="Spark " * (i % 3), skills=[skill("Kafka")] if i % 4 == 0 else []) for i in range(40)]
    df = load(spark, tmp_path, *people)
    rows = R.keyword_topn(df, ["spark", "KAFKA", "kafka"], 15).collect()
    want = sorted(((3 if i % 3 and i % 4 == 0 else 2 if i % 4 == 0 else 1 if i % 3 else 0), i) for i in range(40))
    want = sorted([w for w in want if w[0]], key=lambda w: (-w[0], w[1]))[:15]
    assert sorted([(r["hits"], r["candidate_id"]) for r in rows], key=lambda r: (-r[0], r[1])) == [(h, f"CAND_{i:07d}") for h, i in want]
    assert [r[0] for r in R.keyword_topn(df, [], 3).orderBy("candidate_id").collect()] == [f"CAND_{i:07d}" for i in range(3)]


# -- files and audit --------------------------------------------------------

def _ranked(spark, n=100):
    return spark.range(1, n + 1).select(
        F.format_string("CAND_%07d", "id").alias("candidate_id"), F.col("id").cast("int").alias("rank"),
        (1 - F.floor(F.col("id") / 3) / 1000).alias("score"), F.lit('Good, "very" good').alias("reasoning"))


def test_ranked_csv_round_trip_is_valid(spark, tmp_path):
    ST.write_ranked_csv(_ranked(spark), str(tmp_path / "out"))
    back = ST.read_ranked_csv(spark, str(tmp_path / "out"))
    assert back.first()["reasoning"] == 'Good, "very" good'
    assert A.audit(back, ST.csv_header(spark, str(tmp_path / "out"))).count() == 0


@pytest.mark.parametrize("n", [0, 3, 100, 130])
def test_audit_counts_are_those_of_the_single_checks(spark, n):
    rows = [(f"CAND_{k % 90:07d}" if k % 7 else "odd", str(k % 70 + (k % 11 == 0) * 50), "0.5", "r") for k in range(n)]
    tidy = A.tidy(spark.createDataFrame(rows, "candidate_id string, rank string, score string, reasoning string"))
    single = [part(tidy).select("check", "rank", "candidate_id", "detail") for part in (A.audit_row_count, A.audit_id_unique, A.audit_rank_unique, A.audit_rank_gaps)]
    want = sorted(map(str, [r for part in single for r in part.collect()]))
    assert sorted(map(str, A.audit_counts(tidy).collect())) == want != []


def test_audit_finds_every_kind(spark, tmp_path):
    lines = ["candidate_id,rank,score,note"] + [f"CAND_{i:07d},{i},{1 - i / 1000},ok" for i in range(1, 96)]
    lines[10] = "CAND_0000009,10,0.99,copy of an id"      # duplicate id
    lines[20] = "CAND_20,20,0.98,short id"
    lines[30] = "CAND_0000030,030,0.97,leading zero"
    lines[40] = "CAND_0000040,140,0.96,beyond 100"
    lines[50] = "CAND_0000050,50,high,no number"
    lines[60] = "CAND_0000060,60"                          # two cells
    lines[70] = "CAND_0000070,69,0.93,rank twice"
    lines[80] = "CAND_0000080,80,0.995,rises"
    lines[90] = "CAND_0000001,90,0.911,same score, not in order"
    lines[90] = "CAND_0000002,90,0.911,tie"
    lines += [",,,", "", " , , , "]
    path = tmp_path / "r.csv"
    path.write_text("\n".join(lines))
    found = A.audit(ST.read_ranked_csv(spark, str(path)), ST.csv_header(spark, str(path)))
    kinds = {r["check"] for r in found.collect()}
    assert kinds == {"header", "row_count", "id_format", "rank_valid", "score_numeric", "width", "id_unique", "rank_unique",
                     "rank_gaps", "monotone", "tiebreak"}
    assert [r["detail"] for r in found.where("check = 'row_count'").collect()] == ["expected 100 rows, found 95"]


def test_order_check_on_many_copies(spark):
    """A third of the lines carry one rank; compared with a plain scan."""
    rows = [("CAND_%07d" % (-i % 50), "1" if i % 3 == 0 else str(i % 100 + 1), str((i // 7 % 10) / 10), "x", i) for i in range(900)]
    df = spark.createDataFrame(rows, "candidate_id string, rank string, score string, reasoning string, ingest_ordinal long").repartition(6)
    got = A.audit_order(A.tidy(df)).groupBy("check").count().collect()
    ordered = sorted(rows, key=lambda r: (int(r[1]), r[4]))
    pairs = list(zip(ordered, ordered[1:]))
    rising = sum(float(a[2]) < float(b[2]) for a, b in pairs)
    unordered = sum(float(a[2]) == float(b[2]) and a[0] > b[0] for a, b in pairs)
    assert rising and unordered
    assert {r[0]: r[1] for r in got} == {"monotone": rising, "tiebreak": unordered}


def test_honeypot_share(spark):
    ranked = _ranked(spark)
    verdicts = ranked.select("candidate_id", (F.col("rank") <= 11).alias("is_honeypot"))
    assert A.audit_honeypot_share(ranked, verdicts).first().asDict() == {"n_ranked": 100, "share": 0.11, "failed": True}
    none = verdicts.withColumn("is_honeypot", F.col("candidate_id") <= "CAND_0000010")
    assert A.audit_honeypot_share(ranked, none).first()["failed"] is False


def test_feature_file_kinds(spark, tmp_path):
    with pytest.raises(ValueError):
        ST.read_features(spark, "table.xlsx")
    (tmp_path / "f.csv").write_text("candidate_id,final_score\na,0.5\n")
    assert ST.read_features(spark, str(tmp_path / "f.csv"), None).first()["final_score"] == 0.5


# -- rows that must be neither lost nor multiplied ----------------------------------

def test_only_broken_json_is_rejected(spark, tmp_path):
    base = {"candidate_id": "A", "signals": {"open_to_work_flag": True, "notice_period_days": 30}, "skills": [{"name": "SQL"}], "career_history": [{"title": "T", "is_current": False}]}
    odd = [base, {**base, "signals": {"open_to_work_flag": 1}}, {**base, "signals": {"open_to_work_flag": "true"}}, {**base, "career_history": [{"is_current": "yes"}]},
           {**base, "skills": "Python"}, {**base, "profile": [1]}, {**base, "candidate_id": 7}]
    path = tmp_path / "odd.jsonl"
    path.write_text("\n".join([*map(json.dumps, odd), "[1]", "{"]))
    rows = SP.read_profiles(spark, str(path)).orderBy("ingest_ordinal").collect()
    assert len(rows) == 7 and SP.read_rejected(spark, str(path)).count() == 2
    assert [r["signals"]["open_to_work_flag"] for r in rows[:3]] == [True, True, True]
    assert rows[0]["career_history"][0]["is_current"] is False and rows[3]["career_history"][0]["is_current"] is True
    assert rows[4]["skills"] == [] and rows[4]["career_history"][0]["title"] == "T" and rows[6]["candidate_id"] == "7"


def test_keyword_rows_are_found_by_place(spark):
    rows = [(None, 1, "sql"), (None, 2, "sql"), ("A", 3, "sql"), ("A", 4, "sql"), ("A", 5, "sql"), ("B", 6, "x")]
    df = spark.createDataFrame(rows, "candidate_id string, ingest_ordinal long, t string")
    hits = R.keyword_topn(df, ["sql"], 6, text=F.col("t"), rows=True)
    found = [r["ingest_ordinal"] for r in R.fetch_rows(df, hits).orderBy("ingest_ordinal").collect()]
    assert found == [1, 2, 3, 4, 5]
    twice = spark.createDataFrame([("A", 0.1), ("A", 0.3), (None, 0.2)], "candidate_id string, semantic_score double")
    got = sorted((r["ingest_ordinal"], r["semantic_score"]) for r in R.fetch_by_ids(df, twice).collect())
    assert got == [(1, 0.2), (2, 0.2), (3, 0.3), (4, 0.3), (5, 0.3)]


def test_vectors_with_gaps_take_no_part(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [1.0]), ("d", [0.0, None]), ("e", None), ("f", [0.5, 0.5])], "candidate_id string, embedding array<double>")
    for k in (1, 5):
        assert [r["candidate_id"] for r in R.cosine_topk(df, [1.0, 0.0], k).orderBy("position").collect()] == ["a", "f"][:k]
    assert R.unusable_vectors(df, 2).count() == 5


def test_ranked_csv_keeps_line_breaks(spark, tmp_path):
    ranked = spark.createDataFrame([("A", 1, 0.5, 'Dev\nLead "x"'), ("B", 2, 0.4, "y, z")], "candidate_id string, rank int, score double, reasoning string")
    ST.write_ranked_csv(ranked, str(tmp_path / "r"))
    assert [(r["candidate_id"], r["reasoning"]) for r in ST.read_ranked_csv(spark, str(tmp_path / "r")).orderBy("rank").collect()] == [("A", 'Dev\nLead "x"'), ("B", "y, z")]
    assert ST.csv_header(spark, str(tmp_path / "r")) == ["candidate_id", "rank", "score", "reasoning"]


def test_posting_objects_are_encoded(spark, tmp_path):
    path = tmp_path / "full.json"
    path.write_text(json.dumps({"title": "X", "required_skills": [{"name": "Go", "importance": "required"}, "C++"], "preferred_skills": [{"name": "Rust", "importance": "preferred"}],
                                "responsibilities": ["Build", "Run"], "qualifications": [{"degree": "BSc", "field": "Physics"}]}))
    p = PS.load_posting(spark, str(path))
    assert p.skills[:2] == ("Go", "C++") and p.encoded["responsibilities"] == "Build Run" and p.encoded["qualifications"] == [{"degree": "BSc", "field": "Physics"}]
    made = []

    class Seen(E.HashingEncoder):
        def __call__(self, batch):
            with open(tmp_path / "seen", "w") as file:
                file.write(batch[0])
            return super().__call__(batch)

    from rolecast.plans.flow import encode_posting

    assert len(encode_posting(spark, p, Seen)) == 256 and not made
    assert (tmp_path / "seen").read_text() == "x build run go go go c c c rust rust bsc physics"
    text = tmp_path / "role.txt"
    text.write_text("Some text about Python")
    assert PS.load_posting(spark, str(text)).encoded == {"title": "role", "description": "Some text about Python"}


def test_unicode_blanks_are_stripped(spark):
    assert spark.createDataFrame([("  ",)], "x string").select(C.blank(F.col("x"))).first()[0]
