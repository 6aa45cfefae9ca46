"""Queries that write the derived tables to storage and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators import audit as A
from rolecast.operators.features import feature_table
from rolecast.operators.posting import with_criteria
from rolecast.operators.rank import rank_topk
from rolecast.operators.screen import validate_batch
from rolecast.plans import flow
from rolecast.plans.bindings import CONFIG, POSTING, _id, check_sql, profiles, table
from rolecast.plans.feature_queries import FEATURE_CTES, r
from rolecast.plans.ranking_queries import RANKED_CTES, flat, gappy
from rolecast.plans.registry import query
from rolecast.plans.screen_queries import FACT_CTES, VERDICT_CTE
from rolecast.session import scratch_path
from rolecast.sources import postings as PS
from rolecast.sources import profiles as SP
from rolecast.sources import raw_files as RF
from rolecast.sources import tables as ST
from rolecast.sources.schema import CORRUPT
from rolecast.streaming.screening import screen_new_lines, to_parquet

# Lines that are kept: stray elements in a list of roles, an id given twice, a bare NaN, a part of another kind.
_STRAY, _TWICE = "ingest_ordinal % 70 = 12", "ingest_ordinal % 45 = 13"
_ODD = f"""CASE WHEN {_STRAY} THEN replace(j, '"career_history":[{{', '"career_history":["oops",7,null,{{')
    WHEN {_TWICE} THEN replace(j, '{{"candidate_id":', '{{"candidate_id":"first","extra":NaN,"candidate_id":')
    WHEN ingest_ordinal % 55 = 14 THEN replace(j, '{{"candidate_id":', '{{"languages":"none","candidate_id":') ELSE j END"""
# Every 50th line is cut off, every 60th goes on behind its object and every 40th is blank.
_BROKEN = f"CASE WHEN ingest_ordinal % 50 = 3 THEN substr(j, 1, 40) WHEN ingest_ordinal % 60 = 31 THEN j || ' {{}}' WHEN ingest_ordinal % 40 = 7 THEN '   ' ELSE {_ODD} END"
_REJECTED = "(b % 50 = 3 OR b % 60 = 31)"
_LOST = f"({_REJECTED} OR b % 40 = 7)"
_ODD_PARTS = "CASE WHEN b % 70 = 12 AND b % 107 <> 13 THEN 'career_history' WHEN b % 70 <> 12 AND b % 45 <> 13 AND b % 55 = 14 AND candidate_id IS NOT NULL THEN 'languages' ELSE '' END"


def _lines(spark: SparkSession, sf_dir: str, spoil: bool) -> DataFrame:
    source = profiles(spark, sf_dir)
    fields = F.struct(*[c for c in source.columns if c != "ingest_ordinal"])
    json = source.select("ingest_ordinal", F.to_json(fields).alias("j"))
    return json.selectExpr("ingest_ordinal", f"{_BROKEN if spoil else _ODD} AS value")


@query("scan_jsonl_lenient", check_sql(f"""
SELECT 'read' AS kind, cid AS candidate_id, years_text, (SELECT count(*) FROM role x WHERE x.b = c.b) AS n_roles,
  (SELECT CAST(coalesce(sum(months), 0) AS BIGINT) FROM skill s WHERE s.b = c.b) AS skill_months, {_ODD_PARTS} AS odd FROM cand c WHERE NOT {_LOST}
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, NULL FROM cand WHERE {_REJECTED}"""))
def scan_jsonl_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that is read or rejected."""
    path = scratch_path(spark, "lines")
    _lines(spark, sf_dir, spoil=True).select("value").write.text(path)
    good, bad = SP.read_profiles(spark, path, note_odd=True), SP.read_rejected(spark, path)
    months = F.aggregate("skills", F.lit(0).cast("bigint"), lambda a, s: a + F.coalesce(s["duration_months"].cast("bigint"), F.lit(0).cast("bigint")))
    read = good.select(
        F.lit("read").alias("kind"), F.coalesce("candidate_id", F.lit("UNKNOWN")).alias("candidate_id"), F.col("profile.years_of_experience").alias("years_text"),
        F.size("career_history").cast("bigint").alias("n_roles"), F.coalesce(months, F.lit(0).cast("bigint")).alias("skill_months"), F.array_join("odd_parts", ",").alias("odd"))
    return read.unionByName(bad.select(F.lit("rejected").alias("kind")), allowMissingColumns=True)


@query("scan_jsonl_strict", check_sql("SELECT cid AS candidate_id, years_text, (SELECT count(*) FROM role x WHERE x.b = c.b) AS n_roles FROM cand c"))
def scan_jsonl_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    _lines(spark, sf_dir, spoil=False).select("value").write.text(path)
    return SP.read_profiles_strict(spark, path).select(
        F.coalesce("candidate_id", F.lit("UNKNOWN")).alias("candidate_id"), F.col("profile.years_of_experience").alias("years_text"),
        F.size("career_history").cast("bigint").alias("n_roles"))


def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles as lines with odd but whole ones among them, parsed again."""
    return SP.parse_profiles(_lines(spark, sf_dir, spoil=False)).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


@query("validate_odd_lines", check_sql(
    "SELECT cid AS candidate_id, tier = 'honeypot' AS is_honeypot, risk AS risk_score, tier, reason AS primary_reason, flags FROM tiered",
    *FACT_CTES, VERDICT_CTE))
def validate_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts do not change by what is odd in a line."""
    read = _read_back(spark, sf_dir)
    return validate_batch(read, CONFIG)


@query("screen_arriving_lines", check_sql(
    "SELECT cid AS candidate_id, tier = 'honeypot' AS is_honeypot, risk AS risk_score, tier, reason AS primary_reason, flags FROM tiered",
    *FACT_CTES, VERDICT_CTE))
def screen_arriving_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files arrive twice; the second time most profiles come again, with another headline, and must not count."""
    base = scratch_path(spark, "arriving")
    lines = _lines(spark, sf_dir, spoil=False)
    first = lines.where("ingest_ordinal % 3 <> 1")
    again = first.where("ingest_ordinal % 97 <> 5").withColumn("value", F.regexp_replace("value", '"headline":"', '"headline":"Head of everything '))
    for arriving in (first.select("value"), lines.where("ingest_ordinal % 3 = 1").select("value").unionByName(again.select("value"))):
        arriving.write.mode("append").option("compression", "gzip").text(f"{base}/in")
        stream = spark.readStream.schema("value string").text(f"{base}/in")
        to_parquet(screen_new_lines(stream, config=CONFIG), f"{base}/rows", f"{base}/state").start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")


@query("features_of_odd_lines", check_sql("SELECT candidate_id, skill_score, career_score, signal_score, is_honeypot, days_inactive, risk_score FROM feature", *FEATURE_CTES))
def features_of_odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_table(_read_back(spark, sf_dir), POSTING.criteria(), CONFIG).select(
        "candidate_id", "skill_score", "career_score", "signal_score", "is_honeypot", "days_inactive", "risk_score")


@query("scan_jd_json", """
SELECT CASE WHEN item_id % 3 = 0 THEN '' ELSE coalesce(text, '') END AS title, CASE WHEN item_id % 4 = 0 THEN 0.0e0 ELSE item_id / 2e0 END AS min_years,
  CASE WHEN item_id % 5 = 0 THEN '' ELSE 'python|c|spark' END AS skill_keys, coalesce(text, '') AS description FROM benchmark""")
def scan_jd_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "postings")
    jd = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id", "CASE WHEN item_id % 3 <> 0 THEN text END AS title", "CASE WHEN item_id % 4 <> 0 THEN item_id / 2 END AS min_experience_years",
        "CASE WHEN item_id % 5 <> 0 THEN array('Python', '', 'C++ #') END AS required_skills",
        "CASE WHEN item_id % 5 <> 0 THEN array('Spark') END AS preferred_skills", "text AS description")
    jd.write.partitionBy("item_id").json(path)  # one document per file
    found = with_criteria(PS.read_posting_json(spark, path))
    return found.select("title", "min_years", F.array_join("skill_keys", "|").alias("skill_keys"), "description")


@query("scan_jd_text", """
SELECT CASE WHEN item_id % 2 = 0 THEN 'Engineer ' || item_id ELSE '' END AS title, CASE WHEN item_id % 3 = 0 THEN 4.0e0 ELSE 0.0e0 END AS min_years,
  CASE WHEN item_id % 2 = 0 THEN 'Position: Engineer ' || item_id || chr(10) ELSE '' END || coalesce(text, '')
  || CASE WHEN item_id % 3 = 0 THEN chr(10) || '4 years of experience' ELSE '' END || chr(10) AS description FROM benchmark""")
def scan_jd_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text postings in one file per posting; the whole text is the description."""
    path = scratch_path(spark, "texts")
    texts = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id", "CASE WHEN item_id % 2 = 0 THEN 'Position: Engineer ' || item_id || chr(10) ELSE '' END || coalesce(text, '') || "
        "CASE WHEN item_id % 3 = 0 THEN chr(10) || '4 years of experience' ELSE '' END AS value")
    texts.write.partitionBy("item_id").text(path)
    return PS.read_posting_text(spark, path).select("title", F.col("min_experience_years").alias("min_years"), "description")


# A written file for each benchmark item: quoted header, other order, bytes that are no text, a blank line, wrong widths, quoted breaks.
_HEADER_LINE = "candidate_id,rank,score,reasoning"
_FILE_KINDS = {
    0: '"candidate_id",rank,"score","reasoning"\nCAND_0000001,1,0.5,"two\nlines, ""quoted"""',
    1: "rank,candidate_id,score,reasoning\nCAND_0000001,1,0.5,x",
    2: f"{_HEADER_LINE}\nCAND_0000001,1,0.5,",  # and some bytes that are no text
    3: "",
    4: f'{_HEADER_LINE}\nCAND_0000001,1,0.5\n\n , ,\nCAND_0000002,2,0.4,x,y\nCAND_0000003,3,0.3,"a,b"',
    5: f'{_HEADER_LINE}\r\nCAND_0000001,1,0.5,a "b" c\r\n',
}
_RAW_KIND = "CAST(item_id % 6 AS INTEGER)"


@query("audit_raw_files", f"""
SELECT item_id, 'header' AS "check", 'expected candidate_id,rank,score,reasoning, found rank,candidate_id,score,reasoning' AS detail FROM benchmark WHERE {_RAW_KIND} = 1
UNION ALL SELECT item_id, 'encoding', 'file is not UTF-8' FROM benchmark WHERE {_RAW_KIND} = 2
UNION ALL SELECT item_id, 'header', 'expected candidate_id,rank,score,reasoning, found ' FROM benchmark WHERE {_RAW_KIND} = 3
UNION ALL SELECT item_id, 'width', x FROM benchmark, (SELECT unnest(['CAND_0000001', 'CAND_0000002']) AS x) WHERE {_RAW_KIND} = 4
UNION ALL SELECT item_id, 'reason', CASE {_RAW_KIND} WHEN 0 THEN 'two' || chr(10) || 'lines, "quoted"' WHEN 1 THEN 'x' WHEN 4 THEN 'a,b' WHEN 5 THEN 'a "b" c' END
    FROM benchmark WHERE {_RAW_KIND} IN (0, 1, 4, 5)""")
def audit_raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, encoding, width and cells of written files, from their bytes."""
    path = scratch_path(spark, "raw")
    kind, content = F.expr(_RAW_KIND), F.lit(None).cast("string")
    for k, text in _FILE_KINDS.items():
        value = F.concat(F.lit(text), F.unhex(F.lit("C328FF")).cast("string")) if k == 2 else F.lit(text)
        content = F.when(kind == k, value).otherwise(content)
    table(spark, sf_dir, "benchmark").select("item_id", content.alias("value")).write.partitionBy("item_id").text(path)
    files = RF.read_raw_files(spark, path)
    item = F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("long").alias("item_id")
    rows = A.ranked_records(files)
    wide = rows.where("_corrupt_record IS NOT NULL").select(item, F.lit("width").alias("check"), F.col("candidate_id").alias("detail"))
    good = rows.where("_corrupt_record IS NULL").select(item, F.lit("reason").alias("check"), F.col("reasoning").alias("detail"))
    return A.audit_files(files, ".txt").select(item, "check", "detail").unionByName(wide).unionByName(good)


@query("scan_features", f"""WITH {RANKED_CTES}
SELECT 'csv' AS kind, count(*) AS n, count(semantic_score) AS n_semantic, {r('sum(skill_score)', 4)} AS skill, count_if(is_honeypot) AS n_honeypot FROM flat
UNION ALL SELECT 'tsv', count(*), count(semantic_score), {r('sum(skill_score)', 4)}, count_if(is_honeypot) FROM flat
UNION ALL SELECT 'parquet', count(*), count(semantic_score), {r('sum(skill_score)', 4)}, count_if(is_honeypot) FROM flat""")
def scan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["candidate_id", "semantic_score", "skill_score", "career_score", "signal_score", "is_honeypot", "open_to_work",
               "days_inactive", "interview_completion_rate", F.lit(0).alias("risk_score"), "validation_tier"]
    features = flat(spark, sf_dir).select(*columns)
    base, result = scratch_path(spark, "features"), None
    for kind in ("csv", "tsv", "parquet"):
        path = f"{base}/table.{kind}"
        if kind == "parquet":
            ST.write_features(features, path)
        else:
            features.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
        part = ST.read_features(spark, path).agg(
            F.lit(kind).alias("kind"), F.count("*").alias("n"), F.count("semantic_score").alias("n_semantic"),
            F.round(F.sum("skill_score").cast("decimal(24,10)"), 4).cast("double").alias("skill"), F.count_if("is_honeypot").alias("n_honeypot"))
        result = part if result is None else result.unionByName(part)
    return result


@query("write_features", check_sql("SELECT candidate_id, skill_score, career_score, signal_score, is_honeypot, days_inactive, risk_score FROM feature", *FEATURE_CTES))
def write_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "features") + ".parquet"
    ST.write_features(feature_table(profiles(spark, sf_dir), POSTING.criteria(), CONFIG), path)
    return ST.read_features(spark, path).select(
        "candidate_id", "skill_score", "career_score", "signal_score", "is_honeypot", "days_inactive", "risk_score")


@query("write_ranked_csv", f"""WITH {RANKED_CTES}
SELECT candidate_id, CAST(rank AS STRING) AS rank, {r('final_score')} AS score, 'Rank "' || rank || '", good' AS reasoning FROM ranked WHERE rank <= 100""")
def write_ranked_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "ranked")
    top = rank_topk(gappy(spark, sf_dir)).withColumn("reasoning", F.concat(F.lit('Rank "'), F.col("rank").cast("string"), F.lit('", good')))
    ST.write_ranked_csv(flow.format_ranked(top), path)
    lines = ST.read_ranked_csv(spark, path)
    if ST.csv_header(spark, path) != list(A.HEADER):
        raise AssertionError("unexpected header")
    return lines.select("candidate_id", "rank", F.col("score").cast("double").alias("score"), "reasoning")


@query("embedding_store", f"""
SELECT {_id('vec_id')} AS candidate_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    ST.write_vectors(table(spark, sf_dir, "embeddings").selectExpr(f"{_id('vec_id')} AS candidate_id", "embedding"), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return ST.read_vectors(spark, path).select("candidate_id", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 6).alias("total"))
