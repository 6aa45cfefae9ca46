"""Queries of the predicates and scalar helpers, over whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import scalars as C
from rolecast.functions import text as T
from rolecast.functions.vocabulary import JUMP_SENIOR_TITLES, SENIOR_TITLES
from rolecast.plans.bindings import REFERENCE_DATE, sql_date, table
from rolecast.plans.registry import query

# A text column with numbers, junk, infinities and gaps.
_MESSY = """CASE WHEN event_id % 11 = 0 THEN 'abc' WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'Infinity'
    WHEN event_id % 19 = 0 THEN 'NaN' WHEN event_id % 23 = 0 THEN '' ELSE CAST(value AS STRING) END"""
_TRUTH = """CASE event_id % 9 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN 'no'
    WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '0' ELSE event_type END"""


@query("require_columns", "SELECT count(*) AS n_rows FROM orders WHERE o_totalprice > 1000")
def require_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = C.require_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "orders")
    return checked.where("o_totalprice > 1000").agg(F.count("*").alias("n_rows"))


@query("require_nonempty", "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY 1")
def require_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = C.require_nonempty(table(spark, sf_dir, "orders"), "orders")
    return checked.groupBy("o_orderstatus").agg(F.count("*").alias("n_rows"))


@query("safe_float", f"""
SELECT event_id, CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) ELSE 0.0 END AS v,
       CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) ELSE 1.5 END AS w
FROM (SELECT event_id, {_MESSY} AS x FROM events)""")
def safe_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.expr(_MESSY)
    return table(spark, sf_dir, "events").select("event_id", C.safe_float(x).alias("v"), C.safe_float(x, 1.5).alias("w"))


@query("clip", """
SELECT c_custkey, least(greatest(c_acctbal / 5000, 0), 1) AS unit, least(greatest(c_acctbal, -100), 2500) AS bounded FROM customer""")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", C.clip(F.col("c_acctbal") / 5000).alias("unit"), C.clip(F.col("c_acctbal"), -100.0, 2500.0).alias("bounded"))


@query("minmax_normalise", """
SELECT o_orderkey, (o_totalprice - (SELECT min(o_totalprice) FROM orders)) / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders) AS scaled,
       CAST(0.0 AS DOUBLE) AS flat FROM orders""")
def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("same"))
    return C.minmax_normalise(C.minmax_normalise(df, "o_totalprice", "scaled"), "same", "flat").select("o_orderkey", "scaled", "flat")


@query("clean_text", r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS cleaned FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("truncate_words", """
SELECT doc_id, CASE WHEN length(text) <= 2048 THEN text ELSE regexp_replace(substr(text, 1, 2048), ' [^ ]*$', '') END AS cut FROM documents""")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_words(F.col("text")).alias("cut"))


@query("normalise_skill", """
SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand || '+'), '[^a-z0-9 ]', ' ', 'g')) AS key FROM part""")
def normalise_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("+"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalise_skill(name).alias("key"))


_WANTED = ("red", "small ring", "Gizmo!", "R", "plate, hot")


@query("skill_match", f"""
WITH want AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g')) AS w FROM (SELECT unnest({list(_WANTED)}) AS name)),
     have AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9 ]', ' ', 'g')) AS h FROM part)
SELECT p_partkey, name AS wanted FROM have, want WHERE contains(h, w) OR contains(w, h)""")
def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = T.normalise_skill(F.col("p_name"))
    hit = [F.when(T.skill_match(key, T.normalise_skill(F.lit(w))), F.lit(w)) for w in _WANTED]
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_compact(F.array(*hit))).alias("wanted"))


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


@query("contains_any", f"""
SELECT p_partkey, {_any("p_name || ' ' || p_type", SENIOR_TITLES)} AS senior, {_any("p_name", ("ring", "OLT".lower()))} AS listed,
       {_any("p_type", JUMP_SENIOR_TITLES)} AS jump FROM part""")
def contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        C.contains_any(F.concat_ws(" ", "p_name", "p_type"), SENIOR_TITLES).alias("senior"),
        C.contains_any(F.col("p_name"), ("ring", "olt")).alias("listed"),
        C.contains_any(F.col("p_type"), JUMP_SENIOR_TITLES).alias("jump"),
    )


# Dates in the forms the parser must accept (2024-1-5) or refuse.
_DATES = """CASE k % 7 WHEN 0 THEN CAST(d AS STRING) WHEN 1 THEN CAST(year(d) AS STRING) || '-' || CAST(month(d) AS STRING) || '-' || CAST(day(d) AS STRING)
    WHEN 2 THEN CAST(year(d) AS STRING) || '-02-30' WHEN 3 THEN CAST(year(d) AS STRING) WHEN 4 THEN CAST(d AS STRING) || 'T10'
    WHEN 5 THEN CAST(year(d) AS STRING) || '/01/02' ELSE 'not-a-date' END"""


@query("parse_date", f"""
SELECT k, x AS raw, {sql_date('x')} AS parsed FROM (SELECT k, {_DATES} AS x FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders))""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "CAST(o_orderdate AS DATE) AS d").selectExpr("k", f"{_DATES} AS raw")
    return rows.withColumn("parsed", C.parse_date(F.col("raw")))


@query("months_between_30", """
SELECT l_orderkey, l_linenumber, round((year(s) - year(o)) * 12 + (month(s) - month(o)) + (day(s) - day(o)) / 30.0e0, 6) AS months
FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s, DATE '1998-01-31' AS o FROM lineitem)""")
def months_between_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = C.months_between_30(F.lit("1998-01-31").cast("date"), F.col("l_shipdate").cast("date"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(months, 6).alias("months"))


@query("days_inactive", f"""
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 999 ELSE date_diff('day', CAST(o_orderdate AS DATE), DATE '{REFERENCE_DATE}') END AS INTEGER) AS days
FROM orders""")
def days_inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.days_inactive(last, REFERENCE_DATE).alias("days"))


@query("coerce_bool", f"""
SELECT event_id, lower(trim(x)) IN ('true', '1', 'yes') AS from_text, user_id % 3 <> 0 AS from_number, value > 20 AS from_bool
FROM (SELECT *, {_TRUTH} AS x FROM events)""")
def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_TRUTH} AS x", "user_id % 3 AS m", "value > 20 AS flag")
    return df.select("event_id", C.coerce_bool(df, "x").alias("from_text"), C.coerce_bool(df, "m").alias("from_number"), C.coerce_bool(df, "flag").alias("from_bool"))


@query("safe_value", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, FALSE AS has_extra FROM events""")
def safe_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 7 = 0 THEN double('NaN') ELSE value END AS v")
    return df.select("event_id", C.safe_value(df, "v").alias("v"), F.lit(C.safe_value(df, "extra") is not None).alias("has_extra"))


@query("safe_numeric", f"""
SELECT event_id, CASE WHEN isfinite(try_cast(x AS DOUBLE)) THEN try_cast(x AS DOUBLE) END AS v FROM (SELECT event_id, {_MESSY} AS x FROM events)""")
def safe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr("event_id", f"{_MESSY} AS x")
    return df.select("event_id", C.safe_numeric(df, "x").alias("v"))
