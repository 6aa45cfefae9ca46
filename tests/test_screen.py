"""The fraud screen: golden profiles, one row per rule and its boundary."""

import json

import pytest
from pyspark.sql import functions as F

from rolecast.config import DEFAULT
from rolecast.operators import screen as S
from samples import HONEYPOT, PLANTED, SUSPICIOUS, VALID, degree, load, profile, role, signals, skill


def _experts(n, months):
    return [skill(f"Skill {i}", "expert", 1, months) for i in range(n)]


LONG_OFFICE = "Met clients every week and wrote letters about events in the north."
# name: (profile, flag that must be raised or None, flag that must not be raised or None)
CASES = {
    "blank headline": (profile(headline=" "), "missing_profile_headline", None),
    "no years": (profile(years=None), "missing_profile_years_of_experience", None),
    "blank title": (profile(title=""), "missing_profile_current_title", None),
    "no roles": (profile(career_history=[]), "empty_career_history", None),
    "null roles": (profile(career_history=None), "empty_career_history", None),
    "negative years": (profile(years=-1), "negative_experience", None),
    "55 years": (profile(years=55), "excessive_experience", None),
    "50 years": (profile(years=50), None, "excessive_experience"),
    "unreadable years": (profile(years="many"), "invalid_experience_value", "negative_experience"),
    "negative months": (profile(career_history=[role(months=-5)]), "negative_duration", None),
    "zero months": (profile(career_history=[role(months=0)]), None, "negative_duration"),
    "bad start": (profile(career_history=[role(start="not-a-date")]), "invalid_start_date", None),
    "impossible day": (profile(career_history=[role(start="2024-02-30")]), "invalid_start_date", None),
    "short day": (profile(career_history=[role(start="2024-2-3")]), None, "invalid_start_date"),
    "bad end": (profile(career_history=[role(end="soon")]), "invalid_end_date", None),
    "end first": (profile(career_history=[role(start="2024-06-01", end="2023-01-01")]), "end_before_start", None),
    "same day": (profile(career_history=[role(start="2024-06-01", end="2024-06-01")]), None, "end_before_start"),
    "degree inverted": (profile(education=[degree(2024, 2020)]), "education_year_inverted", None),
    "degree one year": (profile(education=[degree(2024, 2024)]), None, "education_year_inverted"),
    "twin roles": (profile(career_history=[role(), role(title=" backend engineer ")]), "duplicate_career_entry", None),
    "twins without start": (profile(career_history=[role(start=None), role(start=None)]), None, "duplicate_career_entry"),
    "salary": (profile(signals=signals(expected_salary_range_inr_lpa={"min": 50, "max": 20})), "salary_range_inverted", None),
    "salary equal": (profile(signals=signals(expected_salary_range_inr_lpa={"min": 20, "max": 20})), None, "salary_range_inverted"),
    "one expert": (profile(skills=_experts(1, 0)), "expert_skill_zero_duration", None),
    "one month expert": (profile(skills=_experts(1, 1)), None, "expert_skill_zero_duration"),
    "nine near zero": (profile(skills=_experts(9, 2)), "mass_expert_near_zero", "expert_skill_zero_duration"),
    "seven near zero": (profile(skills=_experts(7, 3)), None, "mass_expert_near_zero"),
    "eight at four": (profile(skills=_experts(8, 4)), None, "mass_expert_near_zero"),
    "sum above claim": (profile(years=3, career_history=[role(months=96)]), "experience_sum_exceeds_claimed", None),
    "sum at limit": (profile(years=4, career_history=[role(months=72)]), None, "experience_sum_exceeds_claimed"),
    "claim above sum": (profile(years=10, career_history=[role(months=12)]), "claimed_exceeds_career_sum", None),
    "claim at limit": (profile(years=3, career_history=[role(months=12)]), None, "claimed_exceeds_career_sum"),
    "future start": (profile(career_history=[role(start="2026-06-12")]), "future_start_date", None),
    "starts today": (profile(career_history=[role(start="2026-06-11")]), None, "future_start_date"),
    "too young": (profile(career_history=[role(start="2014-12-31")]), "underage_work_start", None),
    "just old enough": (profile(career_history=[role(start="2015-01-01")]), None, "underage_work_start"),
    "senior in a year": (profile(years=0.5, title="Principal Architect"), "senior_title_trivial_experience", None),
    "senior later": (profile(years=1.1, title="Principal Architect"), None, "senior_title_trivial_experience"),
    "manager list": (profile(years=1, title="Office Manager"), "senior_title_trivial_experience", "unrealistic_growth"),
    "longer than span": (profile(career_history=[role(start="2023-01-01", end="2024-01-01", months=36)]), "duration_exceeds_timespan", None),
    "six months more": (profile(career_history=[role(start="2023-01-01", end="2024-01-01", months=18)]), None, "duration_exceeds_timespan"),
    "21 skills": (profile(skills=[skill(f"S{i}", "Advanced") for i in range(21)]), "skill_count_explosion", None),
    "20 skills": (profile(skills=[skill(f"S{i}", "Advanced") for i in range(20)]), None, "skill_count_explosion"),
    "expert failed": (profile(skills=[skill("Python", "expert")], signals=signals(skill_assessment_scores={" PYTHON ": 10})), "assessment_contradiction", None),
    "expert at 20": (profile(skills=[skill("Python", "expert")], signals=signals(skill_assessment_scores={"Python": 20})), None, "assessment_contradiction"),
    "overlap": (profile(career_history=[role(start="2022-01-01", end="2023-06-01"), role("Other", start="2023-01-01", end="2024-06-01")]), "overlapping_careers", None),
    "overlap of 30 days": (profile(career_history=[role(start="2022-01-01", end="2023-01-31"), role("Other", start="2023-01-01", end="2024-06-01")]), None, "overlapping_careers"),
    "overlap with the role after a short one": (
        profile(career_history=[role(start="2022-01-01", end="2023-06-01"), role("Short", start="2022-02-01", end="2022-02-20"),
                                role("Other", start="2023-01-01", end="2024-06-01")]), "overlapping_careers", None),
    "jump": (profile(career_history=[role("VP Engineering", start="2024-01-01"), role("Junior Intern", start="2023-01-01", end="2023-12-01", months=11)]), "suspicious_career_jump", None),
    "slow rise": (profile(career_history=[role("VP Engineering", start="2025-01-01"), role("Junior Intern", start="2022-12-01", end="2024-12-01", months=24)]), None, "suspicious_career_jump"),
    "growth": (profile(years=2, title="Senior Lead Architect"), "unrealistic_growth", None),
    "growth at 3": (profile(years=3, title="Senior Lead Architect"), None, "unrealistic_growth"),
    "bot": (profile(signals=signals(applications_submitted_30d=25, recruiter_response_rate=0, interview_completion_rate=0)), "fake_activity_pattern", None),
    "20 applications": (profile(signals=signals(applications_submitted_30d=20, recruiter_response_rate=0, interview_completion_rate=0)), None, "fake_activity_pattern"),
    "endorsed": (profile(skills=[skill("X", "beginner", 100, 0)]), "endorsement_anomaly", None),
    "endorsed 50": (profile(skills=[skill("X", "beginner", 50, 0)]), None, "endorsement_anomaly"),
    "complete but empty": (profile(skills=[], career_history=[], signals=signals(profile_completeness_score=90.5)), "completeness_content_mismatch", None),
    "complete at 90": (profile(skills=[], career_history=[], signals=signals(profile_completeness_score=90)), None, "completeness_content_mismatch"),
    "active first": (profile(signals=signals(signup_date="2026-03-01", last_active_date="2025-01-01")), "active_before_signup", None),
    "active same day": (profile(signals=signals(signup_date="2025-01-01", last_active_date="2025-01-01")), None, "active_before_signup"),
    "future certificate": (profile(certifications=[{"name": "A", "year": 2027}]), "future_certification", "premature_certification"),
    "certificate this year": (profile(certifications=[{"name": "A", "year": 2026}]), None, "future_certification"),
    "early certificate": (profile(certifications=[{"name": "A", "year": "x"}, {"name": "B", "year": 2016}, {"name": "C", "year": 2030}]), "premature_certification", "future_certification"),
    "first school year": (profile(certifications=[{"name": "A", "year": 2017}]), None, "premature_certification"),
    "office text": (profile(career_history=[role("Software Engineer", description=LONG_OFFICE)]), "title_description_mismatch", None),
    "office text, 50 characters": (profile(career_history=[role("Software Engineer", description=LONG_OFFICE[:50])]), None, "title_description_mismatch"),
    "no id": (profile(cid=""), "missing_candidate_id", None),
}


@pytest.fixture(scope="module")
def raised(spark, tmp_path_factory):
    lines = [{**p, "languages": [{"language": name}]} for name, (p, _, _) in CASES.items()]
    df = load(spark, tmp_path_factory.mktemp("cases"), *lines)
    rows = S.add_flags(df).select(F.col("languages")[0]["language"].alias("name"), "flags").collect()
    return {r["name"]: r["flags"] for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_rule(raised, name):
    _, wanted, unwanted = CASES[name]
    names = [f["name"] for f in raised[name]]
    if wanted:
        assert wanted in names
    if unwanted:
        assert unwanted not in names


def test_points(raised):
    points = {name: {f["name"]: f["points"] for f in flags} for name, flags in raised.items()}
    assert points["one expert"]["expert_skill_zero_duration"] == 30
    assert points["salary"]["salary_range_inverted"] == 5
    assert points["nine near zero"]["mass_expert_near_zero"] == 40


def test_base_profile_is_clean(spark, tmp_path):
    assert S.add_flags(load(spark, tmp_path, profile())).first()["flags"] == []


@pytest.mark.parametrize("sample,flags,risk,tier", [
    (VALID, {}, 0, "clean"),
    (HONEYPOT, {"expert_skill_zero_duration": 60, "mass_expert_near_zero": 40, "senior_title_trivial_experience": 35,
                "unrealistic_growth": 15, "endorsement_anomaly": 10}, 100, "honeypot"),
    (SUSPICIOUS, {"suspicious_career_jump": 20, "unrealistic_growth": 15}, 35, "clean"),
    (PLANTED, {"suspicious_career_jump": 20, "unrealistic_growth": 15, "endorsement_anomaly": 10, "active_before_signup": 15,
               "future_certification": 10}, 70, "suspicious"),
    ({}, {"missing_candidate_id": 10, "missing_profile_headline": 10, "missing_profile_years_of_experience": 10,
          "missing_profile_current_title": 10, "empty_career_history": 10}, 50, "suspicious"),
])
def test_golden(spark, tmp_path, sample, flags, risk, tier):
    row = S.screen(load(spark, tmp_path, sample)).first()
    assert [(f["name"], f["points"]) for f in row["flags"]] == list(flags.items())
    assert (row["risk_score"], row["validation_tier"], row["is_honeypot"]) == (risk, tier, tier == "honeypot")


def test_reasons(spark, tmp_path):
    rows = {r["candidate_id"]: r for r in S.validate_batch(load(spark, tmp_path, VALID, HONEYPOT, {})).collect()}
    assert rows["CAND_0000001"]["primary_reason"] == "Clean profile"
    assert rows["CAND_HONEY01"]["primary_reason"] == "10 expert skill(s) with 0 months duration — impossible proficiency claim"
    assert rows["UNKNOWN"]["primary_reason"] == "Missing candidate_id field"
    assert list(rows["UNKNOWN"].asDict()) == ["candidate_id", "is_honeypot", "risk_score", "tier", "primary_reason", "flags"]
    assert rows["UNKNOWN"]["flags"].startswith("missing_candidate_id, missing_profile_headline")


@pytest.mark.parametrize("risk,tier,multiplier", [(49, "clean", 1.0), (50, "suspicious", 0.7), (79, "suspicious", 0.7), (80, "honeypot", 0.0)])
def test_tiers(spark, risk, tier, multiplier):
    t = S.risk_tier(F.lit(risk))
    row = spark.range(1).select(t.alias("t"), S.penalty_multiplier(t).alias("m")).first()
    assert (row["t"], row["m"]) == (tier, multiplier)


def test_one_bad_field_only_disables_its_rules(spark, tmp_path):
    bad = profile(years="many", education=[degree(None, 2020), degree(2024, 2020)], skills=_experts(2, 0))
    names = [f["name"] for f in S.add_flags(load(spark, tmp_path, bad)).first()["flags"]]
    assert {"invalid_experience_value", "education_year_inverted", "expert_skill_zero_duration"} <= set(names)


def test_overlap_agrees_with_all_pairs(spark, tmp_path):
    """The linear overlap rule against a check of every pair."""
    import datetime as dt
    import random

    rng = random.Random(7)
    people = []
    for i in range(120):
        roles = []
        for _ in range(rng.randint(1, 9)):
            start = dt.date(2015, 1, 1) + dt.timedelta(days=rng.randint(0, 1500))
            end = None if rng.random() < 0.1 else start + dt.timedelta(days=rng.choice([5, 25, 31, 60, 200, -20]))
            roles.append(role(f"T{rng.randint(0, 99)}", f"C{len(roles)}", str(start), end and str(end)))
        people.append(profile(f"CAND_{i:07d}", career_history=roles))
    found = {r["candidate_id"]: next((f["description"] for f in r["flags"] if f["name"] == "overlapping_careers"), None)
             for r in S.add_flags(load(spark, tmp_path, *people), rules=S.IMPOSSIBLE).collect()}
    for p in people:
        spans = sorted(((dt.date.fromisoformat(r["start_date"]), n, r["end_date"] and dt.date.fromisoformat(r["end_date"]) or DEFAULT.reference_date,
                         r["title"]) for n, r in enumerate(p["career_history"])), key=lambda s: s[0])
        text = next((f"Career roles overlap by {(min(a[2], b[2]) - b[0]).days} days: '{a[3]}' and '{b[3]}'"
                     for i, a in enumerate(spans) for b in spans[i + 1:] if b[0] < a[2] and (min(a[2], b[2]) - b[0]).days > 30), None)
        assert found[p["candidate_id"]] == text


def test_risk_is_capped_sum(spark, tmp_path):
    rows = S.screen(load(spark, tmp_path, *[c[0] for c in CASES.values()])).collect()
    assert all(r["risk_score"] == min(100, sum(f["points"] for f in r["flags"])) for r in rows)


def test_partitioning_does_not_matter(spark, tmp_path):
    df = load(spark, tmp_path, *[c[0] for c in CASES.values()])
    one = sorted(map(str, S.validate_batch(df.coalesce(1)).collect()))
    many = sorted(map(str, S.validate_batch(df.repartition(13)).collect()))
    assert one == many


def test_stream_equals_batch(spark, tmp_path):
    from rolecast.sources.profiles import parse_profiles
    from rolecast.streaming.screening import screen_stream, to_parquet

    source = tmp_path / "in"
    source.mkdir()
    for i, (p, _, _) in enumerate(CASES.values()):
        (source / f"{i}.jsonl").write_text(json.dumps(p) + "\n\n", encoding="utf-8")
    stream = parse_profiles(spark.readStream.text(str(source)))
    to_parquet(screen_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).start().awaitTermination()
    batch = S.validate_batch(parse_profiles(spark.read.text(str(source))))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
