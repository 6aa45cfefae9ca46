"""From profiles to a ranked, explained selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import stable_round
from rolecast.functions.text import candidate_text_blob, posting_text_blob
from rolecast.operators.encode import Encoder, HashingEncoder, batch_embed
from rolecast.operators.features import feature_table
from rolecast.operators.posting import Posting, joined_criteria, with_criteria
from rolecast.operators.rank import DEFAULT_TOP_K, rank_topk, rank_topk_narrow
from rolecast.operators.reason import add_reasoning
from rolecast.operators.retrieve import (
    choose_mode,
    cosine_topk_by_posting,
    fetch_by_ids,
    fetch_rows,
    keyword_topn,
    semantic_retrieve,
)
from rolecast.operators.score import add_final_score
from rolecast.sources.postings import load_posting
from rolecast.sources.profiles import read_profiles
from rolecast.sources.schema import reading_order
from rolecast.sources.tables import (
    read_features,
    read_ranked_csv,
    read_vectors,
    write_features,
    write_ranked_csv,
    write_vectors,
)


def retrieve_and_score(
    profiles: DataFrame,
    posting: Posting,
    vectors: DataFrame | None = None,
    query: Sequence[float] | None = None,
    mode: str = "auto",
    top_n: int | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """Feature table of the profiles retrieved for one posting.

    In keyword mode the semantic score is 0.
    """
    n = top_n or config.retrieval.top_n
    if choose_mode(mode, vectors is not None and query is not None) == "semantic":
        found = fetch_by_ids(profiles, semantic_retrieve(vectors, query, n).drop("position"))
    else:
        hits = keyword_topn(profiles, posting.skills, n, config.retrieval.min_hits, rows=True)
        found = fetch_rows(profiles, hits) if "ingest_ordinal" in profiles.columns else fetch_by_ids(profiles, hits.select("candidate_id"))
    return feature_table(found, posting.criteria(), config)


def run_features(
    spark: SparkSession,
    profiles_path: str,
    posting_path: str,
    output_path: str,
    vectors_path: str | None = None,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    mode: str = "auto",
    top_n: int | None = None,
    signals_field: str = "signals",
    config: Config = DEFAULT,
) -> DataFrame:
    """Raw profiles and one posting to a stored feature table.

    With a vector table the posting is encoded by the same encoder and the
    profiles are retrieved by similarity, otherwise by keyword hits. In ``auto`` mode a
    vector table that is not there means keywords; asked for by name, it is an error.
    """
    posting = load_posting(spark, posting_path)
    profiles = read_profiles(spark, profiles_path, signals_field)
    vectors = query = None
    if vectors_path is not None and mode != "keyword":
        try:
            vectors = read_vectors(spark, vectors_path)
            query = encode_posting(spark, posting, make_encoder)
        except AnalysisException as error:
            if mode != "auto" or error.getCondition() != "PATH_NOT_FOUND":
                raise
    features = retrieve_and_score(profiles, posting, vectors, query, mode, top_n, config)
    write_features(features, output_path)
    return read_features(spark, output_path) if output_path.endswith(".parquet") else spark.read.parquet(output_path)


def build_vectors(
    profiles: DataFrame, path: str, make_encoder: Callable[[], Encoder] = HashingEncoder, config: Config = DEFAULT
) -> None:
    """Encode the text of every profile and store the vectors with their ids."""
    blobs = profiles.select("candidate_id", candidate_text_blob().alias("text"))
    write_vectors(batch_embed(blobs, make_encoder, batch_size=config.retrieval.batch_size), path)


def encode_posting(spark: SparkSession, posting: Posting, make_encoder: Callable[[], Encoder] = HashingEncoder) -> list[float]:
    """The query vector of one posting.

    A posting read from a file is encoded from its own fields: title, description,
    responsibilities, skills with their importance and qualifications, or file name and whole
    text. One made in code has title, description and required skills.
    """
    known = posting.encoded or {
        "title": posting.title, "description": posting.description,
        "required_items": [{"name": s, "importance": "required"} for s in posting.skills],
    }
    skills = lambda name: [(s["name"], s["importance"]) for s in known.get(name, ())]
    row = (
        "query", known.get("title") or "", known.get("description") or "", known.get("responsibilities") or "", skills("required_items"), skills("preferred_items"),
        [(q["degree"], q["field"]) for q in known.get("qualifications", ())],
    )
    kind = "array<struct<name: string, importance: string>>"
    fields = spark.createDataFrame([row], f"""posting_id string, title string, description string, responsibilities string, required_skills {kind},
        preferred_skills {kind}, qualifications array<struct<degree: string, field: string>>""")
    return list(embed_postings(fields, make_encoder).first()["embedding"])


def embed_postings(postings: DataFrame, make_encoder: Callable[[], Encoder] = HashingEncoder, key: str = "posting_id", config: Config = DEFAULT) -> DataFrame:
    """``(key, embedding)`` of a table of postings, each encoded from its text blob like a profile."""
    return batch_embed(postings.select(key, posting_text_blob().alias("text")), make_encoder, key=key, batch_size=config.retrieval.batch_size)


def format_ranked(ranked: DataFrame) -> DataFrame:
    """The four output columns, from a final_score or an existing score."""
    score = "final_score" if "final_score" in ranked.columns else "score"
    return ranked.select(
        "candidate_id",
        F.col("rank").cast("int").alias("rank"),
        stable_round(F.col(score), 6).alias("score"),
        "reasoning",
    )


def load_and_rank(spark: SparkSession, source: str | DataFrame, top_k: int = DEFAULT_TOP_K) -> DataFrame:
    """Rank a scored table given as a frame or as a parquet, csv or tsv path."""
    if isinstance(source, str):
        if source.rstrip("/").endswith(".parquet"):
            # Places of rows in their files are data, so a second, narrow scan finds the same rows.
            stored = read_features(spark, source)
            place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
            return rank_topk_narrow(stored.select("*", place.alias("_place")), top_k, order="ingest_ordinal" if "ingest_ordinal" in stored.columns else "_place").drop("_place")
        # A text table has any columns; only the score is needed as a number, so none is inferred.
        read = read_features(spark, source, None, as_text=True)
        read = read.withColumn("final_score", F.col("final_score").try_cast("double")) if "final_score" in read.columns else read
        source = read if "ingest_ordinal" in read.columns else read.withColumn("ingest_ordinal", reading_order())
    return rank_topk(source, top_k)


def build_and_write(features: DataFrame, path: str, top_k: int = DEFAULT_TOP_K, config: Config = DEFAULT) -> DataFrame:
    """Score, rank, explain, write the CSV, and return what was written."""
    write_ranked_csv(build_ranking(features, top_k, config), path)
    return read_ranked_csv(features.sparkSession, path)


def build_ranking(features: DataFrame, top_k: int = DEFAULT_TOP_K, config: Config = DEFAULT) -> DataFrame:
    """Score, rank, explain and format a feature table."""
    scored = add_final_score(features, config)
    return format_ranked(add_reasoning(rank_topk(scored, top_k), config))


def rank_stored(features: DataFrame, top_k: int = DEFAULT_TOP_K, config: Config = DEFAULT) -> DataFrame:
    """``build_ranking`` of a stored feature table with ``ingest_ordinal``.

    Id, score and place go through the shuffle; skills, titles and the other columns are read for the chosen rows only.
    """
    return format_ranked(add_reasoning(rank_topk_narrow(add_final_score(features, config), top_k), config))


def rank_profiles(profiles: DataFrame, posting: Posting, path: str, top_k: int = DEFAULT_TOP_K, config: Config = DEFAULT) -> DataFrame:
    """All profiles to the ranked, explained selection; the feature table is stored at ``path`` and scored from there."""
    write_features(feature_table(profiles, posting.criteria(), config), path)
    return rank_stored(profiles.sparkSession.read.parquet(path), top_k, config)


def rank_for_postings(
    profiles: DataFrame,
    vectors: DataFrame,
    postings: DataFrame,
    top_n: int | None = None,
    top_k: int = DEFAULT_TOP_K,
    config: Config = DEFAULT,
) -> DataFrame:
    """The ranked selection of every posting of a table.

    ``postings`` has posting_id, embedding and the posting fields. Only
    retrieved pairs are joined with the two tables and scored.
    """
    n = top_n or config.retrieval.top_n
    hits = cosine_topk_by_posting(vectors, postings.select("posting_id", "embedding"), n, config=config)
    wanted = with_criteria(postings).select(
        F.col("posting_id").cast("string").alias("posting_id"),
        F.col("skill_keys").alias("posting_skill_keys"),
        F.col("min_years").alias("posting_min_years"),
        F.col("industry").alias("posting_industry"),
    )
    pairs = (
        hits.select("posting_id", "candidate_id", F.greatest("similarity", F.lit(0.0)).alias("semantic_score"))
        .join(wanted, "posting_id")
        .join(profiles.where(F.col("candidate_id").isNotNull()), "candidate_id")
    )
    scored = add_final_score(feature_table(pairs, joined_criteria(), config), config)
    ranked = add_reasoning(rank_topk(scored, top_k, by=["posting_id"]), config)
    return ranked.select(
        "posting_id", "candidate_id", "rank", stable_round(F.col("final_score"), 6).alias("score"), "reasoning"
    )
