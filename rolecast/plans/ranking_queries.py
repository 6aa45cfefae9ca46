"""Queries of the final score, the ranking, the reasons and the audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import Weights
from rolecast.functions.scalars import days_inactive, parse_date, stable_round
from rolecast.operators import audit as A
from rolecast.operators import rank as R
from rolecast.operators import reason as N
from rolecast.operators import score as S
from rolecast.operators.screen import screen
from rolecast.plans import flow
from rolecast.plans.bindings import CONFIG, POSTING, _id, check_sql, profiles, table, vectors
from rolecast.plans.feature_queries import FEATURE_CTES, r
from rolecast.plans.registry import query
from rolecast.plans.text_queries import _RETRIEVED, _unit_dot
from rolecast.session import scratch_path
from rolecast.sources import tables as ST

# -- a flat feature table, one row per order --------------------------------
# Ids repeat (several orders per customer), scores have gaps, flags are mixed.

FLAT = {
    "candidate_id": _id("o_custkey"),
    "ingest_ordinal": "o_orderkey",
    "semantic_score": "CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE (o_orderkey * 7919 % 10007) / 10007e0 END",
    "skill_score": "o_totalprice / 500000",
    "career_score": "(o_custkey * 31 % 97) / 97e0",
    "signal_score": "(o_orderkey % 101) / 100e0",
    "is_honeypot": "CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 13 = 0 END",
    "open_to_work": "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderstatus <> 'P' END",
    "days_inactive": "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderkey % 400 AS INT) END",
    "interview_completion_rate": "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE (o_orderkey % 17) / 16e0 END",
    "validation_tier": "CASE WHEN o_orderkey % 13 = 0 THEN 'honeypot' WHEN o_orderkey % 7 = 0 THEN 'suspicious' ELSE 'clean' END",
    "skills": "CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 6 = 1 THEN 'Python, SQL' WHEN o_orderkey % 6 = 2 THEN ' Go ,, Rust , C ,Java,Scala, R ' ELSE NULL END",
    "years_experience": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 50000 END",
    "github_activity": "(o_orderkey % 11) / 10e0",
    "responsiveness": "(o_orderkey % 21) / 20e0",
    "current_title": "CASE WHEN o_orderkey % 5 = 0 THEN '  ' WHEN o_orderkey % 5 = 1 THEN NULL ELSE ' ' || o_orderpriority || ' ' END",
    "education_level": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN '' ELSE 'Master ' || o_orderstatus END",
}
FLAT_CTE = "flat AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FLAT.items()) + " FROM orders)"
_P = CONFIG.penalties
_W = CONFIG.weights


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in FLAT.items()])


def _rounded(name: str, x: Column | None = None) -> Column:
    return stable_round(F.col(name) if x is None else x, 6).alias(name)


# -- final score ------------------------------------------------------------

_WEIGHTED = f"({_W.semantic}e0 * coalesce(semantic_score, 0) + {_W.skill}e0 * skill_score + {_W.career}e0 * career_score + {_W.signal}e0 * signal_score)"
_HONEY, _CLOSED = "coalesce(is_honeypot, FALSE)", "NOT coalesce(open_to_work, TRUE)"
_IDLE = f"coalesce(days_inactive, 0) > {_P.inactive_days}"
_UNRELIABLE = f"coalesce(interview_completion_rate, 1) < {_P.interview_rate}"


def final_sql(weighted: str = _WEIGHTED) -> str:
    return (f"least(greatest({weighted} * CASE WHEN {_HONEY} THEN 0.0e0 ELSE 1 END * CASE WHEN {_CLOSED} THEN 0.6e0 ELSE 1 END"
            f" * CASE WHEN {_IDLE} THEN 0.7e0 ELSE 1 END * CASE WHEN {_UNRELIABLE} THEN 0.8e0 ELSE 1 END, 0), 1)")


SCORED_CTE = f"scored AS (SELECT *, {final_sql()} AS final_score FROM flat)"


@query("weighted_score", f"WITH {FLAT_CTE} SELECT ingest_ordinal, {r(_WEIGHTED)} AS weighted FROM flat")
def weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir).select("ingest_ordinal", stable_round(S.weighted_score(CONFIG), 6).alias("weighted"))


@query("weights_check", f"WITH {FLAT_CTE} SELECT count(*) AS n, {r('avg(0.25e0 * (coalesce(semantic_score, 0) + skill_score + career_score + signal_score))', 5)} AS mean FROM flat")
def weights_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights pass the check; weights adding up to 1.2 must not."""
    try:
        Weights(semantic=0.65)
    except ValueError:
        pass
    else:
        raise AssertionError("weights above one were accepted")
    from dataclasses import replace

    even = replace(CONFIG, weights=Weights(0.25, 0.25, 0.25, 0.25))
    return flat(spark, sf_dir).agg(F.count("*").alias("n"), stable_round(F.avg(S.weighted_score(even)), 5).alias("mean"))


def _penalty(name: str, condition: str, multiplier: float, when) -> None:
    @query(name, f"WITH {FLAT_CTE} SELECT ingest_ordinal, {r(f'{_WEIGHTED} * CASE WHEN {condition} THEN {multiplier}e0 ELSE 1 END')} AS score FROM flat")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = flat(spark, sf_dir)
        return df.select("ingest_ordinal", stable_round(S.penalise(S.weighted_score(CONFIG), when(df), multiplier), 6).alias("score"))


_penalty("penalty_honeypot", _HONEY, _P.honeypot_multiplier, S.is_honeypot)
_penalty("penalty_not_open", _CLOSED, _P.not_open_multiplier, S.is_closed)
_penalty("penalty_inactive", _IDLE, _P.inactive_multiplier, lambda df: S.is_inactive(CONFIG))
_penalty("penalty_low_interview", _UNRELIABLE, _P.low_interview_multiplier, lambda df: S.is_unreliable(CONFIG))


@query("final_score", f"WITH {FLAT_CTE}, {SCORED_CTE} SELECT ingest_ordinal, {r('final_score')} AS final_score FROM scored")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.add_final_score(flat(spark, sf_dir), CONFIG).select("ingest_ordinal", _rounded("final_score"))


@query("final_score_tier_multiplier", f"""WITH {FLAT_CTE}, {SCORED_CTE}
SELECT ingest_ordinal, {r("final_score * CASE validation_tier WHEN 'honeypot' THEN 0 WHEN 'suspicious' THEN 0.7e0 ELSE 1 END")} AS final_score FROM scored""")
def final_score_tier_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    config = replace(CONFIG, penalties=replace(CONFIG.penalties, apply_tier_multiplier=True))
    return S.add_final_score(flat(spark, sf_dir), config).select("ingest_ordinal", _rounded("final_score"))


@query("score_stats", f"""WITH {FLAT_CTE}, {SCORED_CTE}
SELECT {r('min(final_score)')} AS min_score, {r('max(final_score)')} AS max_score, {r('avg(final_score)', 5)} AS mean_score, {r('median(final_score)', 6)} AS median_score,
  count_if(final_score = 0) AS n_zero, count(*) AS n_total, count_if({_HONEY}) AS n_honeypot, count_if({_CLOSED}) AS n_not_open,
  count_if({_IDLE}) AS n_inactive, count_if({_UNRELIABLE}) AS n_low_interview FROM scored""")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = S.score_stats(S.add_final_score(flat(spark, sf_dir), CONFIG), CONFIG)
    return stats.withColumns({
        "mean_score": stable_round(F.col("mean_score"), 5), **{f"{c}_score": stable_round(F.col(f"{c}_score"), 6) for c in ("min", "max", "median")}})


# -- ranking ----------------------------------------------------------------

_GAPS = f"""SELECT candidate_id, ingest_ordinal, CASE WHEN ingest_ordinal % 23 <> 0 THEN {r('final_score', 9)} END AS final_score FROM scored"""
RANKED_CTES = f"""{FLAT_CTE}, {SCORED_CTE},
filled AS (SELECT candidate_id, ingest_ordinal, coalesce(final_score, 0) AS final_score FROM ({_GAPS})),
firsts AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY ingest_ordinal) = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, candidate_id) AS rank FROM firsts)"""


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with NULL and NaN, exact to nine places so both engines order alike."""
    scored = S.add_final_score(flat(spark, sf_dir), CONFIG)
    score = stable_round(F.col("final_score"), 9)
    o = F.col("ingest_ordinal")
    return scored.select("candidate_id", "ingest_ordinal", F.when(o % 46 == 0, F.lit(float("nan"))).when(o % 23 != 0, score).alias("final_score"))


@query("null_score_fill", f"WITH {RANKED_CTES} SELECT ingest_ordinal, {r('final_score')} AS final_score FROM filled")
def null_score_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fill_missing_score(gappy(spark, sf_dir)).select("ingest_ordinal", _rounded("final_score"))


@query("dedupe_first", f"WITH {RANKED_CTES} SELECT candidate_id, ingest_ordinal, {r('final_score')} AS final_score FROM firsts")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.dedupe_first(R.fill_missing_score(gappy(spark, sf_dir)))
    return kept.select("candidate_id", "ingest_ordinal", _rounded("final_score"))


@query("rank_all", f"WITH {RANKED_CTES} SELECT candidate_id, {r('final_score')} AS final_score, rank FROM ranked")
def rank_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_all(gappy(spark, sf_dir)).select("candidate_id", _rounded("final_score"), "rank")


@query("rank_topk", f"WITH {RANKED_CTES} SELECT candidate_id, {r('final_score')} AS final_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 100")
def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_topk(gappy(spark, sf_dir)).select("candidate_id", _rounded("final_score"), "rank")


@query("rank_summary", f"""WITH {RANKED_CTES} SELECT CAST(rank AS INTEGER) AS rank, candidate_id, {r('final_score')} AS final_score
FROM ranked WHERE rank <= 5 OR rank BETWEEN 96 AND 100""")
def rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_summary(R.rank_topk(gappy(spark, sf_dir))).select("rank", "candidate_id", _rounded("final_score"))


# -- reasons ----------------------------------------------------------------

_NAMES = "list_filter(list_transform(string_split(skills, ','), lambda s: trim(s)), lambda s: s <> '')"
_Y = "CAST(trunc(years_experience) AS BIGINT)"
FRAGMENTS = {
    "reason_skills": [f"""CASE WHEN len({_NAMES}) > 0 THEN 'strong ' || array_to_string({_NAMES}[1:4], ', ')
        || CASE WHEN len({_NAMES}) > 4 THEN ' (+' || (len({_NAMES}) - 4) || ' more)' ELSE '' END || ' background' END"""],
    "reason_experience": [
        f"CASE WHEN {_Y} >= 5 THEN {_Y} || ' years experience' WHEN {_Y} > 0 THEN {_Y} || ' years experience (early career)' END",
        "CASE WHEN trim(current_title) <> '' THEN 'currently ' || trim(current_title) END"],
    "reason_education": ["CASE WHEN trim(education_level) <> '' THEN trim(education_level) || ' education' END"],
    "reason_components": [
        "CASE WHEN semantic_score >= 0.75 THEN 'excellent profile-to-job semantic match' END",
        "CASE WHEN skill_score >= 0.7 THEN 'highly relevant skill set' END",
        "CASE WHEN career_score >= 0.7 THEN 'strong career progression' END",
        "CASE WHEN signal_score >= 0.7 THEN 'positive engagement signals' END"],
    "reason_signals": [
        "CASE WHEN github_activity >= 0.6 THEN 'high GitHub activity' END",
        "CASE WHEN open_to_work THEN 'open to work' WHEN NOT open_to_work THEN 'not currently marked as open to work' END",
        "CASE WHEN responsiveness >= 0.7 THEN 'highly responsive' END"],
    "reason_penalties": [
        "CASE WHEN is_honeypot THEN '⚠ flagged as honeypot (score zeroed)' END",
        "CASE WHEN days_inactive > 180 THEN 'inactive for ' || days_inactive || ' days (penalty applied)' END",
        """CASE WHEN interview_completion_rate < 0.3 THEN 'low interview completion rate ('
            || CAST(round_even(interview_completion_rate * 100, 0) AS BIGINT) || '%, penalty applied)' END"""],
}


def sentence_sql(fragments: list[str]) -> str:
    body = f"concat_ws(', ', {', '.join(fragments)})"
    return f"CASE WHEN {body} = '' THEN '' ELSE upper(substr({body}, 1, 1)) || substr({body}, 2) || '.' END"


_BUILDERS = {
    "reason_skills": N.skills_fragment,
    "reason_experience": N.experience_fragments,
    "reason_education": lambda df, config: N.education_fragment(df),
    "reason_components": N.component_fragments,
    "reason_signals": N.signal_fragments,
    "reason_penalties": N.penalty_fragments,
}


def _reason(name: str) -> None:
    @query(name, f"WITH {FLAT_CTE} SELECT ingest_ordinal, {sentence_sql(FRAGMENTS[name])} AS text FROM flat")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = flat(spark, sf_dir)
        return df.select("ingest_ordinal", N.sentence(_BUILDERS[name](df, CONFIG)).alias("text"))


for _name in FRAGMENTS:
    _reason(_name)
_ALL = [f for group in FRAGMENTS.values() for f in group]


@query("reasoning", f"WITH {FLAT_CTE} SELECT ingest_ordinal, {sentence_sql(_ALL)} AS reasoning FROM flat")
def reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.add_reasoning(flat(spark, sf_dir), CONFIG).select("ingest_ordinal", "reasoning")


@query("reason_blank_count", f"""WITH {FLAT_CTE}
SELECT count_if(t = '') AS n_blank, count(*) AS n_total FROM (SELECT {sentence_sql(FRAGMENTS['reason_skills'] + FRAGMENTS['reason_components'][:1])} AS t FROM flat)""")
def reason_blank_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow = flat(spark, sf_dir).select("candidate_id", "skills", "semantic_score")
    return N.blank_count(N.add_reasoning(narrow, CONFIG))


# -- output and audit -------------------------------------------------------

@query("format_ranked", f"""WITH {RANKED_CTES}
SELECT candidate_id, CAST(rank AS INTEGER) AS rank, {r('final_score')} AS score, 'x' || rank AS reasoning FROM ranked WHERE rank <= 100""")
def format_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.rank_topk(gappy(spark, sf_dir))
    return flow.format_ranked(top.withColumn("reasoning", F.concat(F.lit("x"), F.col("rank").cast("string"))))


# A long, faulty output: every order as a line of one ranked file.
OUTPUT = {
    "ingest_ordinal": "o_orderkey",
    "candidate_id": f"CASE WHEN o_orderkey % 50 = 7 THEN 'C-' || CAST(o_custkey AS STRING) WHEN o_orderkey % 90 = 11 THEN '' ELSE {_id('o_custkey')} END",
    "rank": "CASE WHEN o_orderkey % 60 = 9 THEN '07' WHEN o_orderkey % 70 = 13 THEN 'x' ELSE CAST(o_orderkey % 120 - o_orderkey % 3 AS STRING) END",
    "score": "CASE WHEN o_orderkey % 80 = 17 THEN 'high' ELSE CAST(floor(o_totalprice / 50000) / 10e0 AS STRING) END",
    "reasoning": "o_orderpriority",
    "_corrupt_record": "CASE WHEN o_orderkey % 100 = 21 THEN 'a,b' END",
}
OUT_CTE = f"""line AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OUTPUT.items())} FROM orders),
good AS (SELECT *, CASE WHEN regexp_matches(rank, '^(0|-?[1-9][0-9]*)$') THEN CAST(rank AS BIGINT) END AS rk, try_cast(score AS DOUBLE) AS sc
  FROM line WHERE _corrupt_record IS NULL)"""


def output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in OUTPUT.items()])


_NONE = "CAST(NULL AS STRING)"


def _audit(name: str, sql: str, run) -> None:
    check = name.removeprefix("audit_")

    @query(name, f"WITH {OUT_CTE} {sql}")
    def audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(A.tidy(output_lines(spark, sf_dir))).where(F.col("check") == check)


_audit("audit_row_count", f"SELECT 'row_count' AS \"check\", {_NONE} AS rank, {_NONE} AS candidate_id, 'expected 100 rows, found ' || count(*) AS detail FROM line HAVING count(*) <> 100", A.audit_row_count)
_audit("audit_width", "SELECT 'width' AS \"check\", rank, candidate_id, 'expected 4 cells' AS detail FROM line WHERE _corrupt_record IS NOT NULL", A.audit_rows)
_audit("audit_id_format", """SELECT 'id_format' AS "check", rank, candidate_id,
    CASE WHEN candidate_id = '' THEN 'candidate_id is required' ELSE 'expected CAND_ and seven digits' END AS detail
    FROM good WHERE NOT regexp_full_match(candidate_id, 'CAND_[0-9]{7}')""", A.audit_rows)
_audit("audit_score_numeric", "SELECT 'score_numeric' AS \"check\", rank, candidate_id, 'score is not a number' AS detail FROM good WHERE sc IS NULL", A.audit_rows)
_audit("audit_id_unique", f"""SELECT 'id_unique' AS "check", {_NONE} AS rank, candidate_id, 'occurs ' || count(*) || ' times' AS detail
    FROM good WHERE regexp_full_match(candidate_id, 'CAND_[0-9]{{7}}') GROUP BY candidate_id HAVING count(*) > 1""", A.audit_id_unique)
_audit("audit_rank_gaps", f"""SELECT 'rank_gaps' AS "check", CAST(n AS STRING) AS rank, {_NONE} AS candidate_id, 'rank is missing' AS detail
    FROM (SELECT unnest(range(1, 101)) AS n) ANTI JOIN good ON rk = n""", A.audit_rank_gaps)
_PAIRS = """SELECT *, lag(sc) OVER o AS sc0, lag(candidate_id) OVER o AS id0 FROM good WHERE rk IS NOT NULL AND sc IS NOT NULL AND candidate_id <> ''
    WINDOW o AS (ORDER BY rk, ingest_ordinal)"""
_audit("audit_monotone", f"SELECT 'monotone' AS \"check\", rank, candidate_id, 'score is above that of the rank before' AS detail FROM ({_PAIRS}) WHERE sc0 < sc", A.audit_order)
_audit("audit_tiebreak", f"SELECT 'tiebreak' AS \"check\", rank, candidate_id, 'equal scores are not in order of candidate_id' AS detail FROM ({_PAIRS}) WHERE sc0 = sc AND id0 > candidate_id", A.audit_order)


@query("audit_rank_valid", f"""WITH {OUT_CTE}
SELECT 'rank_valid' AS "check", rank, candidate_id, CASE WHEN rk IS NULL THEN 'rank is not an integer' ELSE 'rank is not within 1..100' END AS detail
FROM good WHERE rk IS NULL OR rk NOT BETWEEN 1 AND 100
UNION ALL SELECT 'rank_unique', rank, NULL, 'occurs ' || count(*) || ' times' FROM good WHERE rk BETWEEN 1 AND 100 GROUP BY rank HAVING count(*) > 1""")
def audit_rank_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.tidy(output_lines(spark, sf_dir))
    return A.audit_rows(rows).where("check = 'rank_valid'").unionByName(A.audit_rank_unique(rows))


@query("audit_header", """
SELECT 'header' AS "check", 'expected candidate_id,rank,score,reasoning, found ' || CASE WHEN o_orderstatus = 'F' THEN 'candidate_id,score,rank,reasoning'
  ELSE 'candidate_id,rank,points,reasoning' END AS detail, CAST(count(*) AS BIGINT) AS n_lines FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY ALL""")
def audit_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked files with a right header, swapped columns and a wrong name."""
    path = scratch_path(spark, "ranked")
    source = table(spark, sf_dir, "orders").selectExpr(
        "o_orderstatus", f"{_id('o_custkey')} AS candidate_id", "o_orderkey AS rank", "o_totalprice AS score", "o_orderpriority AS reasoning")
    for status, columns in (("O", A.HEADER), ("F", ("candidate_id", "score", "rank", "reasoning")), ("P", ("candidate_id", "rank", "score AS points", "reasoning"))):
        source.where(F.col("o_orderstatus") == status).selectExpr(*columns).write.option("header", True).csv(f"{path}/{status}")
    lines = ST.ranked_lines(spark, f"{path}/*")
    return A.audit_headers(lines).groupBy("check", "detail").agg(F.sum("n_lines").alias("n_lines"))


@query("audit", f"""WITH {OUT_CTE}
SELECT "check", count(*) AS n FROM (
  SELECT 'header' AS "check" UNION ALL SELECT 'row_count' UNION ALL SELECT 'width' FROM line WHERE _corrupt_record IS NOT NULL
  UNION ALL SELECT 'id_format' FROM good WHERE NOT regexp_full_match(candidate_id, 'CAND_[0-9]{{7}}')
  UNION ALL SELECT 'rank_valid' FROM good WHERE rk IS NULL OR rk NOT BETWEEN 1 AND 100
  UNION ALL SELECT 'score_numeric' FROM good WHERE sc IS NULL
  UNION ALL SELECT 'id_unique' FROM (SELECT candidate_id FROM good WHERE regexp_full_match(candidate_id, 'CAND_[0-9]{{7}}') GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'rank_unique' FROM (SELECT rk FROM good WHERE rk BETWEEN 1 AND 100 GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'rank_gaps' FROM (SELECT unnest(range(1, 101)) AS n) ANTI JOIN good ON rk = n
  UNION ALL SELECT 'monotone' FROM ({_PAIRS}) WHERE sc0 < sc
  UNION ALL SELECT 'tiebreak' FROM ({_PAIRS}) WHERE sc0 = sc AND id0 > candidate_id) GROUP BY 1""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.audit(output_lines(spark, sf_dir)).groupBy("check").agg(F.count("*").alias("n"))


# -- whole runs -------------------------------------------------------------

_FEATURE_FLAT = f"""rated AS (SELECT feature.*, coalesce({{semantic}}, 0) AS semantic_score FROM feature {{join}}),
final AS (SELECT *, {final_sql()} AS final_score FROM rated),
uniq AS (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY b) = 1),
top AS (SELECT *, CAST(row_number() OVER (ORDER BY final_score DESC, candidate_id) AS INTEGER) AS rank FROM uniq QUALIFY rank <= {{k}})"""
_OWN_SKILLS = "(SELECT b, list(name ORDER BY idx) AS names FROM skill GROUP BY b)"
_SKILL_FRAGMENT = """CASE WHEN len(names) > 0 THEN 'strong ' || array_to_string(names[1:4], ', ')
    || CASE WHEN len(names) > 4 THEN ' (+' || (len(names) - 4) || ' more)' ELSE '' END || ' background' END"""
_SENTENCE = sentence_sql([_SKILL_FRAGMENT, *[f for n, g in FRAGMENTS.items() if n != "reason_skills" for f in g]])


def _top_sql(k: int, semantic: str = "NULL", join: str = "") -> tuple[str, ...]:
    return (_FEATURE_FLAT.format(k=k, semantic=semantic, join=join),)


@query("audit_honeypot_share", check_sql(
    f"""SELECT count(*) AS n_ranked, {r("avg(CASE WHEN tier = 'honeypot' THEN 1.0e0 ELSE 0 END)")} AS share,
        avg(CASE WHEN tier = 'honeypot' THEN 1.0e0 ELSE 0 END) > 0.1 AS failed
    FROM (SELECT tier FROM cand c JOIN tiered t USING (b) JOIN inactive i USING (b)
      ORDER BY days, coalesce(candidate_id, 'UNKNOWN_' || b) LIMIT 100)""", *FEATURE_CTES))
def audit_honeypot_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of honeypots among the 100 most recently active profiles."""
    name = F.coalesce("candidate_id", F.concat(F.lit("UNKNOWN_"), F.col("ingest_ordinal").cast("string")))
    days = days_inactive(parse_date(F.col("signals")["last_active_date"]), CONFIG.reference_date)
    picked = profiles(spark, sf_dir, with_skills=False).select(name.alias("candidate_id"), days.alias("days")).orderBy("days", "candidate_id").limit(100)
    # Only the ranked profiles are fetched and screened.
    wanted = picked.select(F.col("candidate_id").alias("_ranked"))
    source = profiles(spark, sf_dir)
    verdicts = screen(source.join(wanted, name == F.col("_ranked"), "left_semi"), CONFIG).select(name.alias("candidate_id"), "is_honeypot")
    share = A.audit_honeypot_share(picked, verdicts)
    return share.withColumn("share", stable_round(F.col("share"), 6))


@query("end_to_end", check_sql(
    f"SELECT candidate_id, rank, {r('final_score')} AS score, {_SENTENCE} AS reasoning FROM top LEFT JOIN {_OWN_SKILLS} USING (b)",
    *FEATURE_CTES, *_top_sql(100)))
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All profiles to the ranked, explained top 100."""
    return flow.rank_profiles(profiles(spark, sf_dir), POSTING, scratch_path(spark, "features"), config=CONFIG)


@query("retrieve_and_rank", check_sql(
    f"SELECT candidate_id, rank, {r('final_score')} AS score, {_SENTENCE} AS reasoning FROM top LEFT JOIN {_OWN_SKILLS} USING (b)",
    *FEATURE_CTES, _RETRIEVED, *_top_sql(100, r("hit.semantic_score", 4), "JOIN hit USING (candidate_id)")))
def retrieve_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve by vector, score only the hits, rank and explain them."""
    v = vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select("embedding").first()[0]
    features = flow.retrieve_and_score(profiles(spark, sf_dir), POSTING, v, q, top_n=300, config=CONFIG)
    return flow.build_ranking(features, config=CONFIG)


@query("rank_per_posting", check_sql(
    f"""SELECT posting_id, candidate_id, CAST(row_number() OVER (PARTITION BY posting_id ORDER BY final_score DESC, candidate_id) AS INTEGER) AS rank,
        {r('final_score')} AS score FROM (SELECT *, {final_sql()} AS final_score FROM pair) QUALIFY rank <= 10""",
    *FEATURE_CTES,
    "q AS (SELECT CAST(label AS STRING) AS posting_id, min_by(embedding, vec_id) AS qe FROM embeddings GROUP BY label)",
    f"""near AS (SELECT posting_id, {_id('vec_id')} AS candidate_id, round({_unit_dot('embedding', 'qe')}, 9) AS sim FROM embeddings, q
        QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY sim DESC, candidate_id) <= 50)""",
    f"pair AS (SELECT posting_id, f.*, {r('greatest(sim, 0)', 4)} AS semantic_score FROM near JOIN feature f USING (candidate_id))"))
def rank_per_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    skills = F.array(*[F.lit(s) for s in POSTING.skills])
    wanted = v.groupBy(F.col("label").cast("string").alias("posting_id")).agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumns({
        "title": F.lit(POSTING.title), "required_skills": skills, "preferred_skills": F.array().cast("array<string>"),
        "min_experience_years": F.lit(POSTING.min_years), "industry": F.lit(POSTING.industry), "description": F.lit("")})
    ranked = flow.rank_for_postings(profiles(spark, sf_dir), v, wanted, top_n=50, top_k=10, config=CONFIG)
    return ranked.select("posting_id", "candidate_id", "rank", "score")
