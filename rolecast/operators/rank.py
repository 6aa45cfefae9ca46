"""Ranking: fill, deduplicate, order, take the best."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecast.functions.scalars import require_columns, stable_round
from rolecast.operators.ordered import with_rank

DEFAULT_TOP_K = 100


def fill_missing_score(df: DataFrame) -> DataFrame:
    return df.withColumn("final_score", F.coalesce(F.nanvl("final_score", F.lit(0.0)), F.lit(0.0)))


def dedupe_first(df: DataFrame, key: str | Sequence[str] = "candidate_id", order: str = "ingest_ordinal") -> DataFrame:
    """Keep the row of each key that was read first.

    Spark limits the groups before the exchange, so even a key with a third
    of all rows sends one row per task.
    """
    first = F.row_number().over(W.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order))
    return df.withColumn("_nr", first).where("_nr = 1").drop("_nr")


def rank_order() -> list[Column]:
    return [F.col("final_score").desc(), F.col("candidate_id").asc()]


def _ready(df: DataFrame, round_first: bool, order: str) -> DataFrame:
    require_columns(df, ("candidate_id", "final_score"), "ranking")
    filled = fill_missing_score(df)
    if round_first:
        filled = filled.withColumn("final_score", stable_round(F.col("final_score"), 6))
    if order in df.columns:
        return dedupe_first(filled, order=order)
    # Without a reading order the order of the frame's partitions stands in.
    numbered = filled.withColumn("_order", F.monotonically_increasing_id())
    return dedupe_first(numbered, order="_order").drop("_order")


def rank_all(df: DataFrame, round_first: bool = False, order: str = "ingest_ordinal") -> DataFrame:
    """Rank 1..n over all rows, best score first, then by id."""
    return with_rank(_ready(df, round_first, order), rank_order())


def rank_topk(
    df: DataFrame,
    k: int = DEFAULT_TOP_K,
    by: Sequence[str] = (),
    round_first: bool = False,
    order: str = "ingest_ordinal",
) -> DataFrame:
    """The best ``k`` rows with their rank, overall or per ``by`` columns.

    Of equal ids the first by ``order`` is kept, with ``by`` inside each group.
    """
    if by:
        ready = fill_missing_score(df)
        kept = order if order in df.columns else "_order"
        if kept == "_order":
            ready = ready.withColumn("_order", F.monotonically_increasing_id())
        unique = dedupe_first(ready, [*by, "candidate_id"], kept).drop("_order")
        best = F.row_number().over(W.partitionBy(*by).orderBy(*rank_order()))
        return unique.withColumn("rank", best).where(F.col("rank") <= k)
    top = _ready(df, round_first, order).orderBy(*rank_order()).limit(k)
    # At most k rows reach this window.
    return top.withColumn("rank", F.row_number().over(W.orderBy(*rank_order())))


def rank_topk_narrow(df: DataFrame, k: int = DEFAULT_TOP_K, order: str = "ingest_ordinal") -> DataFrame:
    """``rank_topk`` for a wide stored table with a unique ``order`` column.

    Only key, order and score go through the shuffle that removes duplicates;
    the k chosen rows are then fetched by a second, filtered scan. Worth it when
    reading a row twice is cheaper than shuffling it, so not for features that
    would have to be computed twice.
    """
    require_columns(df, (order,), "narrow ranking")
    best = rank_topk(df.select("candidate_id", "final_score", order), k, order=order)
    chosen = best.select(F.col(order), F.col("rank"))
    # At most k rows are broadcast.
    return fill_missing_score(df).join(F.broadcast(chosen), order)


def rank_summary(ranked: DataFrame, n: int = 5) -> DataFrame:
    """The first and the last ``n`` rows of a ranked selection.

    A selection has at most k rows, so one window holds it and it is planned once.
    """
    last = F.max("rank").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return ranked.withColumn("_last", last).where((F.col("rank") <= n) | (F.col("rank") > F.col("_last") - n)).select(
        "rank", "candidate_id", "final_score"
    )
