"""Sparse TF-IDF vectors, built by Spark's own functions only.

One model, the document frequencies of a table of texts, serves profiles and postings alike. A vector is an array of
``(term, weight)`` of length one, so that the product of two of them is their cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.session import scratch_path

VECTOR = "array<struct<term: string, weight: double>>"


@dataclass(frozen=True)
class TfIdf:
    """``terms`` holds ``(term, df, idf)``; ``n`` is the number of texts."""

    terms: DataFrame
    n: int


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def term_counts(texts: DataFrame, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """``(key, term, tf)`` of cleaned texts; summed before the shuffle."""
    return texts.select(F.col(key), F.explode(_words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_tfidf(texts: DataFrame, key: str = "candidate_id", text: str = "text") -> TfIdf:
    """Document frequencies of all texts, in one aggregation, saved: ``idf = ln((1 + n) / (1 + df)) + 1``.

    Every row is a text, whatever its key. NULL and empty texts count in ``n`` and have no terms.
    """
    spark = texts.sparkSession
    n = texts.count()
    # Each row counts a term once, so no shuffle by row is needed.
    counted = texts.select(F.explode(F.array_distinct(_words(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    path = scratch_path(spark, "tfidf-terms")
    counted.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).write.parquet(path)
    return TfIdf(spark.read.parquet(path), n)


def encode_tfidf(texts: DataFrame, model: TfIdf, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """``(key, vector)``: the unit vector of each text; a text without a known term has an empty one.

    Keys should be unique: rows of one key are one text. Terms that the model does not know are left out. The join is left to
    Spark, which sends out a small vocabulary and splits a frequent term's part of a large one.
    """
    weighted = term_counts(texts, key, text).join(model.terms.select("term", "idf"), "term").withColumn("weight", F.col("tf") * F.col("idf"))
    cells = weighted.select(key, F.struct("term", "weight").alias("_cell"))
    # Texts without a known term come in by their key alone, so no join has to send the vectors once more.
    every = texts.select(key, F.lit(None).cast(dict(cells.dtypes)["_cell"]).alias("_cell"))
    gathered = cells.unionByName(every).groupBy(key).agg(
        F.sqrt(F.sum(F.col("_cell.weight") * F.col("_cell.weight"))).alias("_norm"), F.sort_array(F.collect_list("_cell")).alias("_vector"))
    unit = F.transform("_vector", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.col("_norm")).alias("weight")))
    return gathered.select(key, unit.cast(VECTOR).alias("vector"))
