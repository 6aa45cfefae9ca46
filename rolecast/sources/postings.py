"""Posting readers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.operators.posting import Posting, extract_fields, single_posting
from rolecast.sources.schema import CORRUPT

_SCHEMA = (
    "title STRING, required_skills ARRAY<STRING>, preferred_skills ARRAY<STRING>, "
    f"min_experience_years STRING, industry STRING, description STRING, responsibilities STRING, qualifications STRING, {CORRUPT} STRING"
)


def read_posting_json(spark: SparkSession, path: str) -> DataFrame:
    """Structured postings, one JSON document per file."""
    return with_defaults(
        spark.read.schema(_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).drop(CORRUPT)
    )


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill what a structured posting leaves out: "", [] and 0.

    A skill may be a name or an object with name and importance; the objects are kept as
    ``required_items`` and ``preferred_items``, the lists hold names. Responsibilities are a
    text or a list of texts, qualifications a list of objects with degree and field.
    """
    none = F.array().cast("array<string>")
    lists = {name: F.coalesce(name, none) for name in ("required_skills", "preferred_skills")}
    given = lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string")
    item = lambda s: F.struct(F.coalesce(F.get_json_object(s, "$.name"), s).alias("name"), F.get_json_object(s, "$.importance").alias("importance"))
    duties = given("responsibilities")
    degrees = F.from_json(given("qualifications"), "array<struct<degree: string, field: string>>")
    df = df.withColumns({
        "required_items": F.transform(lists["required_skills"], item), "preferred_items": F.transform(lists["preferred_skills"], item),
        "responsibilities": F.coalesce(F.array_join(F.from_json(duties, "array<string>"), " "), duties, F.lit("")),
        "qualifications": F.filter(F.coalesce(degrees, F.array().cast("array<struct<degree: string, field: string>>")), lambda q: q.isNotNull()),
    })
    years = F.col("min_experience_years").try_cast("double")
    return df.withColumns(
        {
            "title": F.coalesce("title", F.lit("")),
            "required_skills": F.transform("required_items", lambda s: s["name"]),
            "preferred_skills": F.transform("preferred_items", lambda s: s["name"]),
            "min_experience_years": F.coalesce(years, F.lit(0.0)),
            "industry": F.coalesce("industry", F.lit("")),
            "description": F.coalesce("description", F.lit("")),
        }
    )


def read_posting_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text postings, one per file: fields extracted from the text."""
    texts = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"), file_stem(F.col("_metadata.file_path")).alias("file_stem")
    )
    return extract_fields(texts)


def file_stem(path):
    """File name without folder and last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def blob_fields(postings: DataFrame) -> DataFrame:
    """Title (the file name) and description of a text posting, for encoding."""
    return postings.select(F.col("file_stem").alias("title"), F.col("text").alias("description"))


def load_posting(spark: SparkSession, path: str) -> Posting:
    """One posting by file suffix; an empty posting when the file is missing."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("json", "txt", "text", "md"):
        raise ValueError(f"unsupported posting format: .{suffix}; use .json or .txt")
    try:
        if suffix == "json":
            frame = read_posting_json(spark, path)
            parts = ["title", "description", "responsibilities", "required_items", "preferred_items", "qualifications"]
        else:
            frame = read_posting_text(spark, path)
        wanted = (frame.select(*parts) if suffix == "json" else blob_fields(frame)).select(F.struct("*").alias("encoded"))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return Posting()
        raise
    posting = single_posting(frame)
    return replace(posting, encoded=wanted.first()["encoded"].asDict(recursive=True))
