"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is saved as Parquet in
the shared folder and read back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import language, minhash, queries, secrets, substring
from rolecast.llm.common import written

#: A document is rejected when no language is found or its posterior is below this.
LEAST_SCORE = 0.5
#: Percent of shared five-word shingles that makes near-duplicates: that of the operator's own contract, as the stage
#: calls that operator; copies between 80 and 85 percent stay.
NEAR_PERCENT = 85


def _with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``found``, with ``n_chars`` renewed where it is there."""
    return found.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is found with a score of ``LEAST_SCORE`` or more, as predicted by a model of the labelled ones.

    NULL, empty and letterless texts have no language and go; without any label all go. Repeated rows are judged alike, a NULL
    key does not matter, an empty table stays empty.
    """
    model = language.fit(docs)
    judged = language.predict(docs, model)
    return judged.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest key, of each group of near copies.

    Texts without words and rows without a key link with nothing and stay; rows with one key stay or go together; an empty table stays empty.
    """
    kept = minhash.near_duplicates(docs, NEAR_PERCENT).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document (by key) has; ``n_chars`` is renewed.

    Every row stays, a NULL text stays NULL; rows of one key with one text are one document, rows without a key are left as they are; an empty table stays empty.
    """
    return _with_text(docs, substring.dedup_substrings(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mask in the place of each secret; ``n_chars`` is renewed.

    Every row stays, a NULL text stays NULL; repeated rows and rows without a key are masked alike; an empty table stays empty.
    """
    found = secrets.scan(docs)
    return _with_text(docs, found.withColumn("text", secrets.redacted(F.col("text"), secrets.all_spans())))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 1,024 tokens.

    A NULL or empty text is its end token alone; repeated rows and rows without a key are packed one by one; an empty table gives no rows.
    """
    return queries.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]
#: Not expressible in SQL: classifier, hashes and tokenizer. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
