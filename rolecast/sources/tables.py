"""Feature tables, vectors and ranked outputs on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.sources.schema import reading_order

FEATURE_SCHEMA = (
    "candidate_id STRING, semantic_score DOUBLE, skill_score DOUBLE, career_score DOUBLE, "
    "signal_score DOUBLE, is_honeypot BOOLEAN, open_to_work BOOLEAN, days_inactive INT, "
    "interview_completion_rate DOUBLE, risk_score INT, validation_tier STRING"
)
RANKED_COLUMNS = ("candidate_id", "rank", "score", "reasoning")
_RANKED_TEXT = ", ".join(f"{c} STRING" for c in RANKED_COLUMNS) + ", _corrupt_record STRING"


def read_features(spark: SparkSession, path: str, schema: str | T.StructType | None = FEATURE_SCHEMA, as_text: bool = False) -> DataFrame:
    """A feature table from ``.parquet``, ``.csv`` or ``.tsv``.

    Text files are read with the given schema; with ``None`` their types are found by a
    pass over the file, or, with ``as_text``, all columns are text and no pass is spent.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix not in ("csv", "tsv"):
        raise ValueError(f"unsupported file format: .{suffix}")
    reader = spark.read.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("escape", '"')
    return (reader.option("inferSchema", not as_text) if schema is None else reader.schema(schema)).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors stored next to their key: no join by position is needed."""
    df.select("candidate_id", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("candidate_id", "embedding")


def write_ranked_csv(ranked: DataFrame, path: str) -> None:
    """A ranked selection as one CSV part, in rank order, with a header.

    Meant for a top-k selection: one file means one task.
    """
    out = ranked.select(*RANKED_COLUMNS)
    out.coalesce(1).sortWithinPartitions("rank").write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).csv(path)


def read_ranked_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ranked CSV as text columns; rows of another width keep the raw line."""
    return (
        spark.read.schema(_RANKED_TEXT)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .option("multiLine", True)  # a title may hold a line break
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns


def ranked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of ranked CSV files with their file and position in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), reading_order().alias("position"))
