"""Queries of the fraud screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import vocabulary as V
from rolecast.operators import screen as S
from rolecast.plans.bindings import CONFIG, check_sql, document_profiles, profiles, table
from rolecast.plans.registry import query
from rolecast.session import scratch_path
from rolecast.streaming.screening import screen_stream, to_parquet


def has_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


def _flag(points: int | str, text: str, source: str) -> str:
    return f"SELECT cid AS candidate_id, CAST({points} AS INTEGER) AS points, {text} AS description FROM {source}"


_ROLES = "cand JOIN role r USING (b)"
_YEARS = "coalesce(years, CASE WHEN coalesce(years_text, '') = '' THEN 0.0e0 END)"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY b ORDER BY {}) = 1"
_SPAN = """((year(end_d) - year(start_d)) * 12 + (month(end_d) - month(start_d)) + (day(end_d) - day(start_d)) / 30.0e0)"""


def _even(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS STRING)"


_TOTALS = """total AS (SELECT c.b, c.cid, c.years, c.years * 12 AS claimed, sum(coalesce(r.months, 0)) AS months
  FROM cand c JOIN role r ON r.b = c.b WHERE c.years > 0 GROUP BY ALL)"""

# name -> SQL of the flags it raises
RULE_SQL: dict[str, str] = {
    "missing_candidate_id": _flag(10, "'Missing candidate_id field'", "cand WHERE coalesce(candidate_id, '') = ''"),
    "missing_profile_headline": _flag(10, "'Missing critical profile field: headline'", "cand WHERE trim(coalesce(headline, '')) = ''"),
    "missing_profile_years_of_experience": _flag(10, "'Missing critical profile field: years_of_experience'", "cand WHERE trim(coalesce(years_text, '')) = ''"),
    "missing_profile_current_title": _flag(10, "'Missing critical profile field: current_title'", "cand WHERE trim(coalesce(current_title, '')) = ''"),
    "empty_career_history": _flag(10, "'Career history is empty — no work experience records'", "cand ANTI JOIN role USING (b)"),
    "negative_experience": _flag(20, "'Negative years of experience: ' || CAST(years AS STRING)", "cand WHERE years < 0"),
    "excessive_experience": _flag(20, "'Unrealistic years of experience: ' || CAST(years AS STRING) || ' (>50 years)'", "cand WHERE years > 50"),
    "invalid_experience_value": _flag(10, "'years_of_experience is not a valid number'", "cand WHERE years_text IS NOT NULL AND years IS NULL"),
    "negative_duration": _flag(15, "'Negative duration_months (' || months || ') in career role ' || nr || ': ' || title || ' at ' || company", f"{_ROLES} WHERE months < 0"),
    "invalid_start_date": _flag(10, "'Invalid start_date format in career role ' || nr || ': ''' || start_text || ''''", f"{_ROLES} WHERE start_text <> '' AND start_d IS NULL"),
    "invalid_end_date": _flag(10, "'Invalid end_date format in career role ' || nr || ': ''' || end_text || ''''", f"{_ROLES} WHERE end_text <> '' AND end_d IS NULL"),
    "end_before_start": _flag(15, "'end_date (' || end_text || ') before start_date (' || start_text || ') in career role ' || nr || ': ' || title || ' at ' || company", f"{_ROLES} WHERE end_d < start_d"),
    "education_year_inverted": _flag(10, "'Education end_year (' || end_text || ') before start_year (' || start_text || ') at ' || institution",
        "cand JOIN edu USING (b) WHERE CAST(end_text AS BIGINT) < CAST(start_text AS BIGINT)"),
    "duplicate_career_entry": _flag(15, "'Duplicate career entry: ' || title || ' at ' || company || ' starting ' || start_text",
        f"{_ROLES} WHERE trim(start_text) <> '' AND trim(title) <> '' AND trim(company) <> '' "
        "QUALIFY row_number() OVER (PARTITION BY b, lower(trim(company)), lower(trim(title)), trim(start_text) ORDER BY nr) > 1"),
    "salary_range_inverted": _flag(5, "'Salary range inverted: min (' || salary_min || ') > max (' || salary_max || ') LPA'",
        "cand WHERE CAST(salary_min AS DOUBLE) > CAST(salary_max AS DOUBLE)"),
    "expert_skill_zero_duration": _flag("least(n * 30, 60)", "n || ' expert skill(s) with 0 months duration — impossible proficiency claim'",
        "cand JOIN (SELECT b, count(*) AS n FROM skill WHERE lvl = 'expert' AND months = 0 GROUP BY b) USING (b)"),
    "mass_expert_near_zero": _flag(40, "n || ' expert skills with ≤3 months usage — bulk fake proficiency claims'",
        "cand JOIN (SELECT b, count(*) AS n FROM skill WHERE lvl = 'expert' AND months <= 3 GROUP BY b HAVING count(*) >= 8) USING (b)"),
    "experience_sum_exceeds_claimed": _flag(25, f"'Career duration sum (' || months || ' months) vastly exceeds claimed experience (' || {_even('claimed')} || ' months)'",
        "total WHERE months > claimed * 1.5e0 AND months > 24"),
    "claimed_exceeds_career_sum": _flag(25, f"'Claimed experience (' || {_even('claimed')} || ' months) vastly exceeds career history sum (' || months || ' months)'",
        "total WHERE claimed > months * 3 AND claimed > 24"),
    "future_start_date": _flag(20, "'Career role ' || nr || ' starts in the future (' || start_text || ') — impossible'",
        f"{_ROLES}, ref WHERE start_d > today {_FIRST.format('nr')}"),
    "underage_work_start": _flag(20, "'Career role ' || nr || ' starts in ' || year(start_d) || ', but candidate likely born ~' || (first_year - 18) || ' (working before age 16)'",
        f"{_ROLES} JOIN school USING (b) WHERE first_year < 9999 AND year(start_d) < first_year - 18 + 16 {_FIRST.format('nr')}"),
    "senior_title_trivial_experience": _flag(35, f"'Senior-level title ''' || current_title || ''' with only ' || CAST({_YEARS} AS STRING) || ' year(s) experience — impossible progression'",
        f"cand WHERE {_YEARS} <= 1 AND {has_word('current_title', V.SENIOR_TITLES)}"),
    "duration_exceeds_timespan": _flag(20, f"'Role ' || nr || ' claims ' || months || ' months but date range spans only ~' || {_even(_SPAN)} || ' months'",
        f"{_ROLES} WHERE months > 0 AND months > {_SPAN} + 6 {_FIRST.format('nr')}"),
    "skill_count_explosion": _flag(25, "n || ' skills at expert/advanced level — unrealistic breadth of mastery'",
        "cand JOIN (SELECT b, count(*) AS n FROM skill WHERE lvl IN ('expert', 'advanced') GROUP BY b HAVING count(*) > 20) USING (b)"),
    "assessment_contradiction": _flag(20, "'Skill ''' || name || ''' marked expert but assessment score is only ' || score || '/100'",
        f"""(SELECT c.cid, s.b, s.idx, s.name, CASE lower(s.name) WHEN 'sql' THEN a_sql WHEN 'python' THEN a_python WHEN 'spark' THEN a_spark END AS score
             FROM cand c JOIN skill s USING (b) WHERE lvl = 'expert') WHERE try_cast(score AS DOUBLE) < 20 {_FIRST.format('idx')}"""),
    "overlapping_careers": _flag(15, "'Career roles overlap by ' || days || ' days: ''' || t1 || ''' and ''' || t2 || ''''",
        f"""(SELECT x.cid, x.b, x.s AS s1, x.nr AS n1, y.s AS s2, y.nr AS n2, x.title AS t1, y.title AS t2, date_diff('day', y.s, least(x.e, y.e)) AS days
             FROM span x JOIN span y ON x.b = y.b AND (x.s, x.nr) < (y.s, y.nr) AND y.s < x.e)
            WHERE days > 30 {_FIRST.format('s1, n1, s2, n2')}"""),
    "suspicious_career_jump": _flag(20, "'Suspicious jump from ''' || title || ''' to ''' || next_title || ''' in <2 years — unrealistic progression'",
        f"""(SELECT cid, r.*, lead(r.title) OVER o AS next_title, lead(r.start_d) OVER o AS next_start, coalesce(r.start_text, '0000-00-00') AS so
             FROM {_ROLES} WINDOW o AS (PARTITION BY r.b ORDER BY coalesce(r.start_text, '0000-00-00'), r.nr))
            WHERE {has_word('title', V.JUMP_JUNIOR_TITLES)} AND {has_word('next_title', V.JUMP_SENIOR_TITLES)}
              AND coalesce(months, 0) + {_SPAN.replace('start_d', '#').replace('end_d', 'next_start').replace('#', 'end_d')} < 24
            {_FIRST.format('so, nr')}"""),
    "unrealistic_growth": _flag(15, f"'Only ' || CAST({_YEARS} AS STRING) || ' years experience but holds senior title ''' || current_title || ''''",
        f"cand WHERE {_YEARS} < 3 AND {has_word('current_title', V.JUMP_SENIOR_TITLES)}"),
    "fake_activity_pattern": _flag(15, "'Submitted ' || applications || ' applications but 0% response rate and 0% interview completion — bot-like behavior'",
        "cand WHERE CAST(applications AS INT) > 20 AND CAST(response AS DOUBLE) = 0 AND coalesce(CAST(interview AS DOUBLE), 0) = 0"),
    "endorsement_anomaly": _flag(10, "'Skill ''' || name || ''' has ' || endorsements || ' endorsements but 0 months experience — fake endorsements'",
        f"cand JOIN skill USING (b) WHERE months = 0 AND endorsements > 50 {_FIRST.format('idx')}"),
    "completeness_content_mismatch": _flag(20, "'Profile completeness is ' || CAST(CAST(completeness AS DOUBLE) AS STRING) || '% but has 0 skills and empty career history — data inconsistency'",
        "cand ANTI JOIN role USING (b) WHERE CAST(completeness AS DOUBLE) > 90 AND b NOT IN (SELECT b FROM skill)"),
    "active_before_signup": _flag(15, "'Last active (' || last_active || ') before signup (' || signup || ') — impossible timeline'",
        "cand WHERE try_cast(last_active AS DATE) < CAST(signup AS DATE)"),
    "future_certification": _flag(10, "'Certification ''' || name || ''' year ' || y || ' is in the future'", "bad_cert WHERE y > 2026"),
    "premature_certification": _flag(10, "'Certification ''' || name || ''' year ' || y || ' is before education start (' || first_year || ')'", "bad_cert WHERE y <= 2026"),
    "title_description_mismatch": _flag(10, "'Technical title ''' || title || ''' but role description contains no technical keywords — possible fake title'",
        f"""(SELECT * FROM {_ROLES} {_FIRST.format('CASE WHEN is_current THEN 0 ELSE 1 END, nr')})
            WHERE {has_word('title', V.TECHNICAL_TITLES)} AND length(description) > 50 AND NOT {has_word('description', V.TECHNICAL_CONTENT)}"""),
}
RULE_CTES = (
    _TOTALS,
    "span AS (SELECT c.cid, r.b, r.nr, r.title, r.start_d AS s, coalesce(r.end_d, ref.today) AS e FROM cand c JOIN role r USING (b), ref WHERE r.start_d IS NOT NULL)",
    """bad_cert AS (SELECT cid, b, name, y, first_year FROM
        (SELECT c.cid, t.b, t.idx, t.name, try_cast(t.year_text AS BIGINT) AS y, school.first_year FROM cand c JOIN cert t USING (b) LEFT JOIN school USING (b))
        WHERE y > 2026 OR y < first_year QUALIFY row_number() OVER (PARTITION BY b ORDER BY idx) = 1)""",
)
_NEEDS_SKILLS = {
    "expert_skill_zero_duration", "mass_expert_near_zero", "skill_count_explosion", "assessment_contradiction",
    "endorsement_anomaly", "completeness_content_mismatch",
}


def _register_rule(name: str) -> None:
    rules = [r for r in S.ALL_RULES if name in r.names]

    @query(name, check_sql(RULE_SQL[name], *RULE_CTES))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = profiles(spark, sf_dir, with_skills=name in _NEEDS_SKILLS)
        return S.flag_facts(source, CONFIG, rules).where(F.col("name") == name).select("candidate_id", "points", "description")


for _name in RULE_SQL:
    _register_rule(_name)

# -- verdicts ---------------------------------------------------------------



def _with_block(sql: str) -> str:
    """The rule SQL with the block key, since ids may be missing."""
    return sql.replace("SELECT cid AS candidate_id", "SELECT b, cid AS candidate_id", 1)


_POSITION = {name: i for i, name in enumerate(RULE_SQL)}
_ROLE_RULES = ("negative_duration", "invalid_start_date", "invalid_end_date", "end_before_start")


def _facts_sql() -> str:
    parts = []
    for name, sql in RULE_SQL.items():
        body = _with_block(sql)
        if name in _ROLE_RULES:  # reported role by role
            place, inner = _POSITION["negative_duration"], "nr"
        else:
            place = _POSITION[name]
            inner = {"duplicate_career_entry": "nr", "education_year_inverted": "idx"}.get(name, "0")
        body = body.replace("SELECT b,", f"SELECT b, {place} AS place, CAST({inner} AS BIGINT) AS part, {_POSITION[name]} AS rule, '{name}' AS name,", 1)
        parts.append(body)
    return "fact AS (" + " UNION ALL ".join(parts) + ")"


FACT_CTES = (*RULE_CTES, _facts_sql())
VERDICT_CTE = """verdict AS (
  SELECT c.b, c.cid, CAST(least(coalesce(sum(f.points), 0), 100) AS INTEGER) AS risk,
         coalesce(string_agg(f.name, ', ' ORDER BY place, part, rule), '') AS flags,
         coalesce(first(f.description ORDER BY f.points DESC, place, part, rule), 'Clean profile') AS reason
  FROM cand c LEFT JOIN fact f ON f.b = c.b GROUP BY c.b, c.cid),
tiered AS (SELECT *, CASE WHEN risk >= 80 THEN 'honeypot' WHEN risk >= 50 THEN 'suspicious' ELSE 'clean' END AS tier FROM verdict)"""


@query("validate_batch", check_sql(
    "SELECT cid AS candidate_id, tier = 'honeypot' AS is_honeypot, risk AS risk_score, tier, reason AS primary_reason, flags FROM tiered",
    *FACT_CTES, VERDICT_CTE))
def validate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.validate_batch(profiles(spark, sf_dir), CONFIG)


@query("risk_score", check_sql("SELECT b AS ingest_ordinal, risk AS risk_score FROM tiered", *FACT_CTES, VERDICT_CTE))
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_flags(profiles(spark, sf_dir), CONFIG).select("ingest_ordinal", S.risk_score(F.col("flags"), CONFIG).alias("risk_score"))


@query("risk_tier", check_sql("SELECT tier, count(*) AS n, min(risk) AS min_risk, max(risk) AS max_risk FROM tiered GROUP BY tier", *FACT_CTES, VERDICT_CTE))
def risk_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screen(profiles(spark, sf_dir), CONFIG).groupBy(F.col("validation_tier").alias("tier")).agg(
        F.count("*").alias("n"), F.min("risk_score").alias("min_risk"), F.max("risk_score").alias("max_risk"))


@query("primary_reason", check_sql("SELECT b AS ingest_ordinal, reason AS primary_reason FROM tiered", *FACT_CTES, VERDICT_CTE))
def primary_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_flags(profiles(spark, sf_dir), CONFIG).select("ingest_ordinal", S.primary_reason(F.col("flags")).alias("primary_reason"))


@query("penalty_multiplier", check_sql(
    "SELECT b AS ingest_ordinal, CAST(CASE tier WHEN 'honeypot' THEN 0.0 WHEN 'suspicious' THEN 0.7 ELSE 1.0 END AS DOUBLE) AS multiplier FROM tiered",
    *FACT_CTES, VERDICT_CTE))
def penalty_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screen(profiles(spark, sf_dir), CONFIG).select(
        "ingest_ordinal", S.penalty_multiplier(F.col("validation_tier"), CONFIG).alias("multiplier"))


@query("flag_report", check_sql("SELECT name, count(*) AS n_flags, CAST(sum(points) AS BIGINT) AS total_points FROM fact GROUP BY name", *FACT_CTES))
def flag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.flag_report(profiles(spark, sf_dir), CONFIG)


# The documents as profiles: 10 points for each missing field cannot occur;
# only these rules can fire on them.
@query("screen_stream", r"""
WITH line AS (
  SELECT doc_id, source, lang, n_chars, j, x, string_split(x, ' ')[1] AS word
  FROM (SELECT doc_id, source, lang, n_chars, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS j FROM documents)),
per AS (
  SELECT doc_id, count(*) AS n_lines, any_value(n_chars) AS n_chars,
         count(*) FILTER (j % 4 IN (0, 3) AND j = 0) AS zero_expert,
         count(*) FILTER (j % 4 IN (0, 3) AND j <= 3) AS near_zero,
         count(*) FILTER (j % 4 IN (0, 1, 3)) AS high,
         first(x ORDER BY j) AS head
  FROM line GROUP BY doc_id)
SELECT count(*) AS n_profiles, count_if(high > 20) AS n_explosion, count_if(zero_expert > 0) AS n_expert_zero,
       count_if(n_chars % 100 > 50) AS n_endorsed, count_if(trim(head) = '') AS n_no_headline
FROM per""")
def screen_stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen the documents as a stream, then count verdicts in the written table."""
    # The table is one file or a folder of files. A stream takes the path of a single file only as a pattern, with a base folder named.
    source = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("basePath", sf_dir).parquet(f"{sf_dir}/documents.[p]arquet")
    out = scratch_path(spark, "screened")
    to_parquet(screen_stream(document_profiles(source), CONFIG), f"{out}/rows", f"{out}/state").start().awaitTermination()
    flags = F.split("flags", ", ")
    return spark.read.parquet(f"{out}/rows").agg(
        F.count("*").alias("n_profiles"),
        F.count_if(F.array_contains(flags, "skill_count_explosion")).alias("n_explosion"),
        F.count_if(F.array_contains(flags, "expert_skill_zero_duration")).alias("n_expert_zero"),
        F.count_if(F.array_contains(flags, "endorsement_anomaly")).alias("n_endorsed"),
        F.count_if(F.array_contains(flags, "missing_profile_headline")).alias("n_no_headline"),
    )
