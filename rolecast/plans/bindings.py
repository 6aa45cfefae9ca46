"""Profiles, postings and vectors derived from the driver tables.

A profile is a block of four consecutive order keys. Since the order key is
unique, a block holds at most four roles whatever the size of the table, so
the nested arrays stay small by construction. Line items are first summed per
(block, skill), and there are 24 skills. Irregular values are planted by key
so that every rule has rows that raise it.

The expressions are plain SQL that Spark and the checking engine both read.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import DEFAULT
from rolecast.operators.posting import Posting
from rolecast.sources.schema import normalise_arrays

REFERENCE_DATE = dt.date(2001, 8, 1)
CONFIG = replace(DEFAULT, reference_date=REFERENCE_DATE)

SKILL_NAMES = (
    "Python", "SQL", "Spark", "Java", "Scala", "C++", "Docker", "Kubernetes", "Kafka", "Airflow",
    "PyTorch", "NLP", "Machine Learning", "Pandas", "Linux", "Git", "React", "Tableau", "Excel",
    "Power BI", "A/B Testing", "Data Engineering", "Statistics", "日本語",
)
POSTING = Posting(
    title="Data Engineer",
    skills=("Python", "SQL", "Spark", "Data Engineering", "Learning"),
    skill_keys=("python", "sql", "spark", "data engineering", "learning"),
    min_years=5.0,
    industry="IT Services",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(n: str) -> str:
    text = f"CAST({n} AS STRING)"
    return f"'CAND_' || lpad({text}, CAST(greatest(7, length({text})) AS INT), '0')"


def _text(e: str) -> str:
    return f"CAST({e} AS STRING)"


def _int(e: str) -> str:
    return f"CAST(floor({e}) AS BIGINT)"


ORDERS = {
    "k": "o_orderkey",
    "b": _int("o_orderkey / 4"),
    "i": "CAST(o_orderkey % 4 AS INT)",
    "st": "o_orderstatus",
    "p": "o_totalprice",
    "d": "CAST(o_orderdate AS DATE)",
    "pr": "o_orderpriority",
}
_TWIN = "b % 23 = 0 AND i >= 2"
ROLE = {
    "b": "b",
    "i": "i",
    "company": f"CASE WHEN {_TWIN} THEN 'Initech' ELSE 'Company ' || st END",
    "title": f"""CASE WHEN {_TWIN} THEN 'Analytics Engineer' WHEN pr = '1-URGENT' THEN 'Senior Engineer'
        WHEN pr = '2-HIGH' THEN 'Lead Architect' WHEN pr = '3-MEDIUM' THEN 'Backend Developer'
        WHEN pr = '5-LOW' THEN 'Junior Intern' ELSE 'Associate Analyst' END""",
    "start_text": f"""CASE WHEN {_TWIN} THEN '1999-05-01' WHEN k % 37 = 5 THEN 'not-a-date'
        WHEN k % 41 = 7 THEN '2002-01-15' WHEN k % 53 = 11 THEN '' WHEN k % 59 = 3 THEN NULL
        ELSE {_text('d')} END""",
    "end_text": f"""CASE WHEN i = 0 AND st = 'P' THEN NULL WHEN k % 43 = 9 THEN {_text('d + CAST(-40 AS INT)')}
        WHEN k % 47 = 13 THEN '2000-13-45' ELSE {_text('d + CAST(floor(p / 1000) AS INT)')} END""",
    "months_text": f"""CASE WHEN k % 31 = 4 THEN '-5' WHEN k % 29 = 6 THEN {_text(_int('p / 30000') + ' + 30')}
        WHEN k % 613 = 8 THEN 'n/a' ELSE {_text(_int('p / 30000'))} END""",
    "is_current": "i = 0 AND st = 'P'",
    "industry": "CASE WHEN k % 17 = 0 THEN '' WHEN st = 'O' THEN 'IT Services' WHEN st = 'F' THEN 'Paper Products' ELSE 'Health' END",
    "description": """CASE WHEN k % 5 = 0 THEN 'Managed accounts and met clients every week in the northern region.'
        WHEN k % 5 = 1 THEN 'Office work.' ELSE 'Built data pipelines and deployed cloud services for ' || pr END""",
}
CANDIDATE = {
    "b": "b",
    "candidate_id": f"CASE WHEN b % 97 = 5 THEN NULL ELSE {_id('b')} END",
    "headline": "CASE WHEN b % 67 = 3 THEN '' ELSE t0 || ' at ' || c0 END",
    "summary": "'Professional in ' || ind0",
    "current_title": "CASE WHEN b % 71 = 4 THEN '  ' ELSE t0 END",
    "current_industry": "ind0",
    "years_text": f"""CASE WHEN b % 73 = 6 THEN '-2' WHEN b % 79 = 8 THEN '55' WHEN b % 83 = 10 THEN 'n/a'
        WHEN b % 89 = 12 THEN NULL ELSE {_text('floor(p0 / 6250) / 10.0e0')} END""",
    "completeness": f"CASE WHEN b % 107 = 13 THEN '95' ELSE {_text(_int('p0 / 5000'))} END",
    "signup": f"CASE WHEN b % 27 = 3 THEN '2001-12-31' ELSE {_text('dmin')} END",
    "last_active": f"CASE WHEN b % 101 = 9 THEN 'soon' WHEN b % 103 = 11 THEN NULL ELSE {_text('dmax')} END",
    "open_flag": "CASE WHEN b % 50 = 7 THEN NULL ELSE b % 9 <> 0 END",
    "applications": _text("b % 40"),
    "response": f"CASE WHEN b % 5 = 0 THEN '0' ELSE {_text('n_f / (n * 1.0e0)')} END",
    "hours": _text(_int("p0 / 2500")),
    "notice": _text("(b % 7) * 25"),
    "salary_min": _text("b % 40"),
    "salary_max": _text("b % 40 + b % 9 - 1"),
    "github": f"CASE WHEN b % 10 = 0 THEN '-1' ELSE {_text('b * 7 % 101')} END",
    "searches": _text("b * 13 % 400"),
    "saves": _text("b % 25"),
    "interview": f"CASE WHEN b % 7 = 0 THEN '0' WHEN b % 21 = 5 THEN NULL ELSE {_text('n_hi / (n * 1.0e0)')} END",
    "offers": f"CASE WHEN b % 6 = 0 THEN '-1' WHEN b % 12 = 1 THEN NULL ELSE {_text('(b % 11) / 10.0e0')} END",
    "email": "b % 4 <> 0",
    "phone": "b % 3 <> 0",
    "a_sql": _text("b * 17 % 101"),
    "a_python": _text("b * 29 % 101"),
    "a_spark": f"CASE WHEN b % 4 = 0 THEN 'n/a' ELSE {_text('b * 31 % 101')} END",
    "y0": "CAST(year(d0) AS INT)",
}
_E1 = "CASE WHEN b % 19 = 2 THEN y0 + 9 WHEN b % 91 = 3 THEN NULL ELSE y0 - 6 END"
EDUCATION = (
    # (present when, institution, degree, field, start, end, tier)
    ("b % 11 <> 1", f"'Institute ' || {_text('b % 7')}", "'B.Tech'", "'Computer Science'", _text(_E1),
     f"CASE WHEN b % 23 = 4 THEN {_text(f'{_E1} - 1')} ELSE {_text(f'{_E1} + 4')} END",
     f"CASE WHEN b % 5 = 0 THEN 'unknown' ELSE 'tier_' || {_text('b % 5')} END"),
    ("b % 11 <> 1 AND b % 3 = 0", "'College'", "'M.Sc'", "'Statistics'", _text("y0 - 1"), _text("y0 + 1"), "' TIER_2 '"),
)
CERTIFICATES = (
    ("b % 2 = 0", "'Cloud Cert'", f"""CASE WHEN b % 26 = 2 THEN '2030' WHEN b % 34 = 4 THEN '1985'
        WHEN b % 38 = 6 THEN 'n.d.' ELSE {_text('y0')} END"""),
    ("b % 6 = 0", "'Data Cert'", _text("y0 + 1")),
)
_NAME = "CASE code " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SKILL_NAMES)) + " END"
SKILL = {
    "b": "b",
    "code": "code",
    "name": _NAME,
    "level": """CASE WHEN b % 39 = 2 THEN 'advanced' WHEN b % 33 = 1 THEN 'expert' WHEN qty >= 45 THEN 'Expert'
        WHEN qty >= 30 THEN 'advanced' WHEN qty >= 15 THEN 'intermediate' ELSE 'beginner' END""",
    "months_text": f"""CASE WHEN b % 33 = 1 THEN '0' WHEN b % 17 = 3 AND code % 6 = 0 THEN NULL
        ELSE {_text('months')} END""",
    "endorsements_text": _text("endorsed"),
}


def _exprs(spec: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in spec.items()]


def _sql(spec: dict[str, str]) -> str:
    return ", ".join(_exprs(spec))


# -- Spark ------------------------------------------------------------------

def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Orders are dealt as they are stored: the texts of the roles are longer.
    orders = table(spark, sf_dir, "orders").selectExpr(*_exprs(ORDERS)).repartition("b")
    return orders.selectExpr("*", *_exprs({n: e for n, e in ROLE.items() if n not in ("b", "i")}))


def skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").selectExpr(
        f"{_int('l_orderkey / 4')} AS b", "CAST(l_partkey % 24 AS INT) AS code",
        "l_quantity", "l_linenumber", "l_extendedprice",
    ).repartition("b")  # once for both groupings that follow
    summed = items.groupBy("b", "code").agg(
        F.sum("l_quantity").alias("qty"),
        (F.sum("l_linenumber") - F.count("*")).alias("months"),
        F.expr(_int("max(l_extendedprice) / 1000")).alias("endorsed"),
    )
    return summed.selectExpr(*_exprs(SKILL))


def profiles(spark: SparkSession, sf_dir: str, with_skills: bool = True) -> DataFrame:
    """Nested profiles in the canonical schema, plus ``ingest_ordinal``."""
    role = (
        "struct(i, company, title, start_text AS start_date, end_text AS end_date, "
        "months_text AS duration_months, is_current, industry, "
        "CAST(NULL AS STRING) AS company_size, description)"
    )
    per_block = role_rows(spark, sf_dir).groupBy("b").agg(
        F.sort_array(F.collect_list(F.expr(role))).alias("roles"),
        F.min_by("p", "k").alias("p0"), F.min_by("d", "k").alias("d0"),
        F.min_by("title", "k").alias("t0"), F.min_by("company", "k").alias("c0"),
        F.min_by("industry", "k").alias("ind0"),
        F.max("d").alias("dmax"), F.min("d").alias("dmin"), F.count("*").alias("n"),
        F.count_if(F.col("st") == "F").alias("n_f"),
        F.count_if(F.col("pr").isin("1-URGENT", "2-HIGH")).alias("n_hi"),
    )
    base = per_block.selectExpr("roles", *_exprs(CANDIDATE))
    no_skill = "CAST(array() AS array<struct<name:string,proficiency:string,endorsements:string,duration_months:string>>)"
    if with_skills:
        kept = skill_rows(spark, sf_dir).groupBy("b").agg(
            F.sort_array(F.collect_list(F.expr("struct(code, name, level, endorsements_text, months_text)"))).alias("found")
        )
        base = base.join(kept, "b", "left")
        every = ", ".join(
            f"named_struct('name', '{n}', 'proficiency', 'advanced', 'endorsements', '3', 'duration_months', '12')"
            for n in SKILL_NAMES
        )
        skills = (
            f"CASE WHEN b % 107 = 13 THEN {no_skill} WHEN b % 39 = 2 THEN array({every}) "
            "ELSE transform(found, s -> named_struct('name', s.name, 'proficiency', s.level, "
            "'endorsements', s.endorsements_text, 'duration_months', s.months_text)) END"
        )
    else:
        skills = no_skill

    def rows(entries, make) -> str:
        return "array_compact(array(" + ", ".join(f"CASE WHEN {e[0]} THEN {make(e)} END" for e in entries) + "))"

    education = rows(EDUCATION, lambda e: (
        f"named_struct('institution', {e[1]}, 'degree', {e[2]}, 'field_of_study', {e[3]}, "
        f"'start_year', {e[4]}, 'end_year', {e[5]}, 'grade', CAST(NULL AS STRING), 'tier', {e[6]})"))
    certificates = rows(CERTIFICATES, lambda c: (
        f"named_struct('name', {c[1]}, 'issuer', CAST(NULL AS STRING), 'year', {c[2]})"))
    nested = base.selectExpr(
        "candidate_id",
        "named_struct('headline', headline, 'summary', summary, 'years_of_experience', years_text, "
        "'current_title', current_title, 'current_industry', current_industry) AS profile",
        "CASE WHEN b % 107 = 13 THEN CAST(array() AS array<struct<company:string,title:string,start_date:string,"
        "end_date:string,duration_months:string,is_current:boolean,industry:string,company_size:string,description:string>>) "
        "ELSE transform(roles, r -> named_struct('company', r.company, 'title', r.title, 'start_date', r.start_date, "
        "'end_date', r.end_date, 'duration_months', r.duration_months, 'is_current', r.is_current, "
        "'industry', r.industry, 'company_size', r.company_size, 'description', r.description)) END AS career_history",
        f"{education} AS education",
        f"{skills} AS skills",
        f"{certificates} AS certifications",
        "named_struct('profile_completeness_score', completeness, 'signup_date', signup, 'last_active_date', last_active, "
        "'open_to_work_flag', open_flag, 'applications_submitted_30d', applications, 'recruiter_response_rate', response, "
        "'avg_response_time_hours', hours, 'skill_assessment_scores', map('SQL', a_sql, 'python ', a_python, 'Spark', a_spark), "
        "'notice_period_days', notice, 'expected_salary_range_inr_lpa', named_struct('min', salary_min, 'max', salary_max), "
        "'github_activity_score', github, 'search_appearance_30d', searches, 'saved_by_recruiters_30d', saves, "
        "'interview_completion_rate', interview, 'offer_acceptance_rate', offers, 'verified_email', email, "
        "'verified_phone', phone) AS signals",
        "b AS ingest_ordinal",
    )
    return nested


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(f"{_id('vec_id')} AS candidate_id", "embedding", "label", "vec_id")


_FIRST_WORD = "split(x, ' ')[0]"


def document_profiles(documents: DataFrame) -> DataFrame:
    """One profile per document, built from its own lines; also for streams."""
    return normalise_arrays(
        documents.selectExpr("*", r"split(text, '\n') AS lines").selectExpr(
            f"{_id('doc_id')} AS candidate_id",
            "named_struct('headline', lines[0], 'summary', text, 'years_of_experience', CAST(doc_id % 12 AS STRING), "
            "'current_title', source, 'current_industry', lang) AS profile",
            f"transform(lines, (x, j) -> named_struct('company', lang, 'title', {_FIRST_WORD}, 'start_date', "
            "CAST(2000 + j % 20 AS STRING) || '-01-01', 'end_date', CAST(NULL AS STRING), 'duration_months', "
            "CAST(doc_id % 50 AS STRING), 'is_current', j = 0, 'industry', lang, 'company_size', CAST(NULL AS STRING), "
            "'description', x)) AS career_history",
            "array(named_struct('institution', source, 'degree', 'Degree ' || source, 'field_of_study', lang, "
            "'start_year', '1999', 'end_year', '2003', 'grade', CAST(NULL AS STRING), 'tier', 'tier_1')) AS education",
            f"transform(lines, (x, j) -> named_struct('name', {_FIRST_WORD}, 'proficiency', "
            "CASE j % 4 WHEN 0 THEN 'expert' WHEN 1 THEN 'advanced' WHEN 2 THEN 'intermediate' ELSE 'Expert' END, "
            "'endorsements', CAST(n_chars % 100 AS STRING), 'duration_months', CAST(j AS STRING))) AS skills",
            "array(named_struct('name', 'Cert: ' || lang || '!', 'issuer', source, 'year', '2010')) AS certifications",
            "named_struct('profile_completeness_score', '50', 'signup_date', '2000-01-01', 'last_active_date', '2001-01-01', "
            "'open_to_work_flag', doc_id % 5 <> 0, 'applications_submitted_30d', '3', 'recruiter_response_rate', '0.5', "
            "'avg_response_time_hours', '10', 'skill_assessment_scores', CAST(map() AS map<string,string>), "
            "'notice_period_days', '30', 'expected_salary_range_inr_lpa', named_struct('min', '5', 'max', '9'), "
            "'github_activity_score', '40', 'search_appearance_30d', '100', 'saved_by_recruiters_30d', '4', "
            "'interview_completion_rate', '0.9', 'offer_acceptance_rate', '0.5', 'verified_email', true, "
            "'verified_phone', true) AS signals",
            "doc_id AS ingest_ordinal",
        )
    )


# Text of a posting made around the whole text of a document.
POSTING_TEXT = """CASE WHEN doc_id % 3 = 0 THEN 'Job Title: ' || source || chr(10) ELSE 'Hello' || chr(10) END
    || text || chr(10)
    || CASE WHEN doc_id % 4 = 1 THEN 'Needs ' || CAST(doc_id % 13 AS STRING) || '.5+ years of experience' || chr(10)
            WHEN doc_id % 4 = 2 THEN CAST(doc_id % 9 AS STRING) || ' year experience' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 1 THEN 'Industry: ' || lang || chr(10) WHEN doc_id % 5 = 2 THEN 'Sector - ' || source || chr(10) ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN 'Required Skills:' || chr(10) || '- Python (must)' || chr(10) || '* ' || source
            || ' basics' || chr(10) || '- a phrase that is far too long' || chr(10) || 'Responsibilities: - none' ELSE '' END"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS posting_id", f"{POSTING_TEXT} AS text")


# -- checking SQL -----------------------------------------------------------

def _union(entries, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT b, {idx} AS idx, " + ", ".join(f"{e} AS {c}" for e, c in zip(entry[1:], columns)) + f" FROM cand WHERE {entry[0]}"
        for idx, entry in enumerate(entries, start=1)
    )


_VALID = r"'^\d{4}-\d{1,2}-\d{1,2}$'"


def sql_date(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_VALID}) THEN CAST(try_strptime({x}, '%Y-%m-%d') AS DATE) END"


BASE_CTES = f"""
o AS (SELECT {_sql(ORDERS)} FROM orders),
role0 AS (SELECT {_sql(ROLE)}, k FROM o),
block AS (
  SELECT o.b, min_by(o.p, o.k) AS p0, min_by(o.d, o.k) AS d0, min_by(r.title, o.k) AS t0, min_by(r.company, o.k) AS c0,
         min_by(r.industry, o.k) AS ind0, max(o.d) AS dmax, min(o.d) AS dmin, count(*) AS n,
         count(*) FILTER (o.st = 'F') AS n_f, count(*) FILTER (o.pr IN ('1-URGENT', '2-HIGH')) AS n_hi
  FROM o JOIN role0 r ON r.k = o.k GROUP BY o.b),
cand AS (SELECT *, coalesce(candidate_id, 'UNKNOWN') AS cid, try_cast(years_text AS DOUBLE) AS years FROM (SELECT {_sql(CANDIDATE)} FROM block)),
role AS (
  SELECT r.b, row_number() OVER (PARTITION BY r.b ORDER BY r.i) AS nr, r.* EXCLUDE (b, k),
         {sql_date('r.start_text')} AS start_d, {sql_date('r.end_text')} AS end_d,
         CAST(trunc(try_cast(r.months_text AS DOUBLE)) AS BIGINT) AS months
  FROM role0 r WHERE r.b % 107 <> 13),
skill0 AS (
  SELECT {_int('l_orderkey / 4')} AS b, CAST(l_partkey % 24 AS INT) AS code, sum(l_quantity) AS qty,
         CAST(sum(l_linenumber) - count(*) AS BIGINT) AS months, {_int('max(l_extendedprice) / 1000')} AS endorsed
  FROM lineitem GROUP BY 1, 2),
skill1 AS (
  SELECT {_sql(SKILL)} FROM skill0 WHERE b % 107 <> 13 AND b % 39 <> 2
  UNION ALL
  SELECT b, CAST(code AS INT), {_NAME}, 'advanced', '12', '3' FROM cand, (SELECT unnest(range(24)) AS code) WHERE b % 39 = 2 AND b % 107 <> 13),
skill AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.b ORDER BY code) AS idx, lower(level) AS lvl,
         coalesce(CAST(months_text AS BIGINT), 0) AS months, CAST(endorsements_text AS BIGINT) AS endorsements
  FROM skill1 s SEMI JOIN cand USING (b)),
edu AS ({_union(EDUCATION, ('institution', 'degree', 'field', 'start_text', 'end_text', 'tier'))}),
school AS (SELECT b, min(CAST(start_text AS BIGINT)) AS first_year FROM edu GROUP BY b),
cert AS ({_union(CERTIFICATES, ('name', 'year_text'))}),
ref AS (SELECT DATE '{REFERENCE_DATE}' AS today)
"""


def check_sql(select: str, *ctes: str) -> str:
    """SQL over the derived tables; further CTEs come before the select."""
    return "WITH " + ", ".join([BASE_CTES.strip(), *ctes]) + "\n" + select
