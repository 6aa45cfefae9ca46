"""Queries of the three feature scores and the feature table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import vocabulary as V
from rolecast.operators import career as K
from rolecast.operators import signal as G
from rolecast.operators import skill as L
from rolecast.operators.features import feature_table
from rolecast.plans.bindings import CONFIG, POSTING, check_sql, profiles
from rolecast.plans.registry import query
from rolecast.plans.screen_queries import FACT_CTES, VERDICT_CTE, has_word


def r(x: str, digits: int = 6) -> str:
    """Rounding as in ``stable_round``."""
    return f"CAST(round(CAST({x} AS DECIMAL(24, 10)), {digits}) AS DOUBLE)"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'))"


_WANTED = ", ".join(f"('{k}')" for k in POSTING.skill_keys)
_N_WANTED = len(POSTING.skill_keys)
_LEVEL = "CASE lvl " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in V.PROFICIENCY.items()) + " ELSE 0.0e0 END"

SKILL_CTES = (
    f"want AS (SELECT * FROM (VALUES {_WANTED}) AS t(w))",
    f"""matched AS (SELECT s.*, {_key('s.name')} AS key, {_LEVEL} AS level_value FROM skill s
        WHERE EXISTS (SELECT 1 FROM want WHERE contains({_key('s.name')}, w) OR contains(w, {_key('s.name')})))""",
    """scored_skill AS (SELECT c.b, c.cid, coalesce(m.direct, 0) AS direct, coalesce(m.prof, 0) AS prof,
          coalesce(m.assessed, 0) AS assessed, coalesce(m.dur, 0) AS dur
        FROM cand c LEFT JOIN (
          SELECT b, least(count(*) / %d.0e0, 1) AS direct, avg(level_value) AS prof, least(avg(months) / 36.0e0, 1) AS dur,
            avg(CASE key WHEN 'sql' THEN try_cast(a_sql AS DOUBLE) WHEN 'python' THEN try_cast(a_python AS DOUBLE)
                WHEN 'spark' THEN try_cast(a_spark AS DOUBLE) END / 100) AS assessed
          FROM matched JOIN cand USING (b) GROUP BY b) m USING (b))""" % _N_WANTED,
    """skill_total AS (SELECT *, least(greatest(0.40e0 * direct + 0.25e0 * prof + 0.20e0 * assessed + 0.15e0 * dur, 0), 1) AS skill_score FROM scored_skill)""",
)
_OLD = "'0000-00-00'"
CAREER_CTES = (
    f"""latest AS (SELECT b, title FROM role QUALIFY row_number() OVER
        (PARTITION BY b ORDER BY is_current DESC, coalesce(start_text, {_OLD}) DESC, nr) = 1)""",
    f"""career AS (SELECT c.b, c.cid,
          CASE WHEN {POSTING.min_years}e0 > 0 THEN least(greatest(coalesce(years, 0), 0) / {POSTING.min_years}e0, 1) END AS experience,
          CASE WHEN l.b IS NULL THEN 0.3e0 WHEN {has_word('l.title', V.SENIOR_TITLES)} THEN 1.0e0
               WHEN {has_word('l.title', V.JUNIOR_TITLES)} THEN 0.2e0 ELSE 0.6e0 END AS progression,
          CASE WHEN t.m IS NULL THEN 0.5e0 WHEN t.m < 6 THEN 0.1e0 WHEN t.m < 12 THEN 0.5e0 WHEN t.m <= 36 THEN 1.0e0 ELSE 0.8e0 END AS tenure,
          CASE WHEN t.now THEN 1.0e0 WHEN t.ever THEN 0.6e0 ELSE 0.2e0 END AS industry,
          coalesce(e.best, 0.25e0) AS education
        FROM cand c LEFT JOIN latest l USING (b)
        LEFT JOIN (SELECT b, avg(months) FILTER (months > 0) AS m,
            bool_or(is_current AND (contains(lower(industry), 'it services') OR contains('it services', lower(industry)))) AS now,
            bool_or(contains(lower(industry), 'it services') OR contains('it services', lower(industry))) AS ever
          FROM role GROUP BY b) t USING (b)
        LEFT JOIN (SELECT b, max(CASE lower(trim(tier)) WHEN 'tier_1' THEN 1.0e0 WHEN 'tier_2' THEN 0.75e0 WHEN 'tier_3' THEN 0.5e0 ELSE 0.25e0 END) AS best
          FROM edu GROUP BY b) e USING (b))""",
    """career_total AS (SELECT *, 0.30e0 * experience + 0.25e0 * progression + 0.20e0 * tenure + 0.15e0 * industry + 0.10e0 * education AS career_score FROM career)""",
)


def _ladder(x: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {b} THEN {s}e0" for b, s in steps) + f" ELSE {G.BEYOND}e0 END"


def _num(x: str) -> str:
    return f"coalesce(try_cast({x} AS DOUBLE), 0)"


SIGNAL_CTES = (
    """inactive AS (SELECT b, coalesce(date_diff('day', try_cast(last_active AS DATE), today), 999) AS days FROM cand, ref)""",
    f"""signal AS (SELECT c.b, c.cid, i.days,
          0.4e0 * CASE WHEN open_flag THEN 1 ELSE 0.4e0 END + 0.4e0 * {_ladder('i.days', G.RECENCY_STEPS)}
            + 0.2e0 * {_ladder(_num('notice'), G.NOTICE_STEPS)} AS availability,
          0.4e0 * least(greatest({_num('response')}, 0), 1) + 0.3e0 * {_ladder(_num('hours'), G.RESPONSE_STEPS)}
            + 0.3e0 * least(greatest({_num('interview')}, 0), 1) AS responsiveness,
          0.25e0 * CASE WHEN email THEN 1 ELSE 0 END + 0.25e0 * CASE WHEN phone THEN 1 ELSE 0 END
            + 0.30e0 * least(greatest({_num('completeness')} / 100, 0), 1)
            + 0.20e0 * CASE WHEN CAST(offers AS DOUBLE) >= 0 THEN least(CAST(offers AS DOUBLE), 1) ELSE 0.5e0 END AS credibility,
          0.4e0 * least({_num('saves')} / 20, 1) + 0.3e0 * least({_num('searches')} / 300, 1)
            + 0.3e0 * least(greatest({_num('github')} / 100, 0), 1) AS market_demand,
          least(greatest({_num('github')} / 100, 0), 1) AS github
        FROM cand c JOIN inactive i USING (b))""",
    """signal_total AS (SELECT *, 0.35e0 * availability + 0.30e0 * responsiveness + 0.20e0 * credibility + 0.15e0 * market_demand AS signal_score FROM signal)""",
)


def _component(name: str, ctes: tuple[str, ...], source: str, column: str, add, spark_column: str, with_skills: bool) -> None:
    @query(name, check_sql(f"SELECT b AS ingest_ordinal, {r(column)} AS {name} FROM {source}", *ctes))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = add(profiles(spark, sf_dir, with_skills))
        return scored.select("ingest_ordinal", F.round(F.col(spark_column).cast("decimal(24,10)"), 6).cast("double").alias(name))


for _name, _column in (("skill_direct", "direct"), ("skill_proficiency", "prof"), ("skill_assessment", "assessed"),
                       ("skill_duration", "dur"), ("skill_score", "skill_score")):
    _component(_name, SKILL_CTES, "skill_total", _column, lambda df: L.add_skill_scores(df, POSTING.criteria(), CONFIG), _name, True)
for _name, _column in (("career_experience", "experience"), ("career_progression", "progression"), ("career_tenure", "tenure"),
                       ("career_industry", "industry"), ("career_education", "education"), ("career_score", "career_score")):
    _component(_name, CAREER_CTES, "career_total", _column, lambda df: K.add_career_scores(df, POSTING.criteria()), _name, False)
for _name, _column in (("signal_availability", "availability"), ("signal_responsiveness", "responsiveness"),
                       ("signal_credibility", "credibility"), ("signal_market_demand", "market_demand"), ("signal_score", "signal_score")):
    _component(_name, SIGNAL_CTES, "signal_total", _column, lambda df: G.add_signal_scores(df, CONFIG), _name, False)


@query("skill_matched", check_sql("SELECT b AS ingest_ordinal, idx, name FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY code) - 1 AS idx FROM (SELECT * EXCLUDE (idx) FROM matched))", *SKILL_CTES))
def skill_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = POSTING.criteria().skill_keys
    found = profiles(spark, sf_dir).select("ingest_ordinal", F.posexplode(L.matched_skills(F.col("skills"), keys)).alias("idx", "s"))
    return found.select("ingest_ordinal", F.col("idx").cast("bigint").alias("idx"), "s.name")


# Postings by priority of an order; keys are words of the skills, pieces of them, an unknown and an empty one.
_POSTING_KEYS = {"p1": ("python", "sql", "data"), "p2": ("a", "machine learning models"), "p3": ("", "react"), "p4": ("cobol",), "p5": ("ka", "c", "power bi")}
_KEY_ROWS = ", ".join(f"('{p}', '{k}')" for p, keys in _POSTING_KEYS.items() for k in keys)


@query("skill_matched_by_posting", check_sql(f"""
SELECT DISTINCT s.b AS ingest_ordinal, posting_id, CAST(rank - 1 AS BIGINT) AS idx, name
FROM (SELECT *, {_key('name')} AS key, row_number() OVER (PARTITION BY b ORDER BY code) AS rank FROM skill) s
JOIN (SELECT * FROM (VALUES {_KEY_ROWS}) AS t(posting_id, w)) ON contains(key, w) OR contains(w, key)"""))
def skill_matched_by_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(p, list(keys)) for p, keys in _POSTING_KEYS.items()], "posting_id string, skill_keys array<string>")
    found = L.matched_skill_rows(profiles(spark, sf_dir), asked)
    return found.select("ingest_ordinal", "posting_id", F.col("idx").cast("bigint").alias("idx"), "name")


# -- the feature table ------------------------------------------------------

_BAD = """(SELECT c.b, (coalesce(years_text, '') <> '' AND years IS NULL) OR (coalesce(last_active, '') <> '' AND try_cast(last_active AS DATE) IS NULL)
    OR EXISTS (SELECT 1 FROM role x WHERE x.b = c.b AND coalesce(x.months_text, '') <> '' AND x.months IS NULL) AS error FROM cand c)"""
FEATURE_CTE = f"""feature AS (
  SELECT c.b, coalesce(c.candidate_id, 'UNKNOWN_' || c.b) AS candidate_id, x.error AS scoring_error,
    CASE WHEN error THEN 0.0e0 ELSE {r('skill_score', 4)} END AS skill_score,
    CASE WHEN error THEN 0.0e0 ELSE {r('career_score', 4)} END AS career_score,
    CASE WHEN error THEN 0.0e0 ELSE {r('signal_score', 4)} END AS signal_score,
    t.tier = 'honeypot' AS is_honeypot, CASE WHEN error THEN TRUE ELSE coalesce(open_flag, TRUE) END AS open_to_work,
    CAST(CASE WHEN error THEN 999 ELSE g.days END AS INTEGER) AS days_inactive,
    CASE WHEN error THEN 1.0e0 ELSE {r('coalesce(nullif(CAST(interview AS DOUBLE), 0), 1.0e0)', 4)} END AS interview_completion_rate,
    t.risk AS risk_score, t.tier AS validation_tier, c.years AS years_experience, g.github AS github_activity,
    g.responsiveness, c.current_title, e.degree AS education_level
  FROM cand c JOIN {_BAD} x USING (b) JOIN skill_total s USING (b) JOIN career_total k USING (b) JOIN signal_total g USING (b)
  JOIN tiered t USING (b) LEFT JOIN (SELECT * FROM edu QUALIFY row_number() OVER (PARTITION BY b ORDER BY idx) = 1) e USING (b))"""
FEATURE_CTES = (*FACT_CTES, VERDICT_CTE, *SKILL_CTES, *CAREER_CTES, *SIGNAL_CTES, FEATURE_CTE)


@query("feature_table", check_sql(
    f"""SELECT b AS ingest_ordinal, candidate_id, 0.0e0 AS semantic_score, skill_score, career_score, signal_score, is_honeypot, open_to_work,
        days_inactive, interview_completion_rate, risk_score, validation_tier, years_experience, {r('github_activity')} AS github_activity,
        {r('responsiveness')} AS responsiveness, current_title, education_level, scoring_error FROM feature""", *FEATURE_CTES))
def feature_table_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = feature_table(profiles(spark, sf_dir), POSTING.criteria(), CONFIG)
    return table.drop("skills").withColumns({
        c: F.round(F.col(c).cast("decimal(24,10)"), 6).cast("double") for c in ("github_activity", "responsiveness")})


_EXACT = replace(CONFIG, skill_matching="exact")


_EXACT_CTES = (SKILL_CTES[0], SKILL_CTES[1][: SKILL_CTES[1].index("WHERE EXISTS")] + f"WHERE EXISTS (SELECT 1 FROM want WHERE {_key('s.name')} = w))", *SKILL_CTES[2:])


@query("skill_score_exact_match", check_sql(
    f"SELECT b AS ingest_ordinal, {r('direct')} AS skill_direct, {r('prof')} AS skill_proficiency, {r('assessed')} AS skill_assessment, {r('dur')} AS skill_duration, {r('skill_score')} AS skill_score FROM skill_total",
    *_EXACT_CTES))
def skill_score_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = L.add_skill_scores(profiles(spark, sf_dir), POSTING.criteria(), _EXACT)
    names = ("skill_direct", "skill_proficiency", "skill_assessment", "skill_duration", "skill_score")
    return scored.select("ingest_ordinal", *[F.round(F.col(c).cast("decimal(24,10)"), 6).cast("double").alias(c) for c in names])
