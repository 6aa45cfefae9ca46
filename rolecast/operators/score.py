"""Final score: weighted components and multiplicative penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import clip, coerce_bool, require_columns, safe_float
from rolecast.operators.screen import penalty_multiplier
from rolecast.session import scratch_path

COMPONENTS = ("semantic_score", "skill_score", "career_score", "signal_score")
PENALTY_INPUTS = ("is_honeypot", "open_to_work", "days_inactive", "interview_completion_rate")


def weighted_score(config: Config = DEFAULT) -> Column:
    w = config.weights
    return (
        w.semantic * safe_float(F.col("semantic_score"))
        + w.skill * safe_float(F.col("skill_score"))
        + w.career * safe_float(F.col("career_score"))
        + w.signal * safe_float(F.col("signal_score"))
    )


def is_honeypot(df: DataFrame) -> Column:
    return F.coalesce(coerce_bool(df, "is_honeypot"), F.lit(False))


def is_closed(df: DataFrame) -> Column:
    return ~F.coalesce(coerce_bool(df, "open_to_work"), F.lit(True))


def is_inactive(config: Config = DEFAULT) -> Column:
    return safe_float(F.col("days_inactive")) > config.penalties.inactive_days


def is_unreliable(config: Config = DEFAULT) -> Column:
    return safe_float(F.col("interview_completion_rate"), 1.0) < config.penalties.interview_rate


def penalise(score: Column, when: Column, multiplier: float) -> Column:
    return F.when(when, score * multiplier).otherwise(score)


def add_final_score(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add final_score in [0, 1]."""
    require_columns(df, (*COMPONENTS, *PENALTY_INPUTS), "the final score")
    p = config.penalties
    score = weighted_score(config)
    score = penalise(score, is_honeypot(df), p.honeypot_multiplier)
    score = penalise(score, is_closed(df), p.not_open_multiplier)
    score = penalise(score, is_inactive(config), p.inactive_multiplier)
    score = penalise(score, is_unreliable(config), p.low_interview_multiplier)
    if p.apply_tier_multiplier:
        require_columns(df, ("validation_tier",), "the tier multiplier")
        score = score * penalty_multiplier(F.col("validation_tier"), config)
    return df.withColumn("final_score", clip(score))


RANGES = 1_024


def nth_values(scores: DataFrame, column: str, places: list[int]) -> list[float]:
    """The values at some places (from 0) of a column's sorted order; numbers only, nothing is gathered.

    Counts the values in ``RANGES`` equal ranges between the least and the largest, goes on inside the range that holds
    the place, and ends when that range holds a single value. Each round is one scan and sends one row per range to the driver.
    """
    out = []
    for place in places:
        rows, before = scores, 0
        low, high = scores.agg(F.min(column), F.max(column)).first()
        while low != high:
            # Half of each number, as the width of the widest range does not fit a double.
            span = high / 2 - low / 2
            share = (F.col(column) / 2 - F.lit(low / 2)) / F.lit(span) if span else F.when(F.col(column) > low, 1.0).otherwise(0.0)
            ranges = rows.groupBy(F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("r")).agg(
                F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
            for r in sorted(ranges.collect(), key=lambda r: r.low):
                if place < before + r.n:
                    break
                before += r.n
            if (r.low, r.high) == (low, high):  # neighbours that the division cannot part
                n_low = rows.where(F.col(column) == low).count()
                if place < before + n_low:
                    high = low
                else:
                    before += n_low
                    rows = rows.where(F.col(column) > low)
                    low = rows.agg(F.min(column)).first()[0]
                continue
            low, high = r.low, r.high
            rows = scores.where(F.col(column).between(low, high))
        out.append(low)
    return out


def exact_median(scores: DataFrame, column: str) -> float | None:
    """The median of a column's numbers, as they are; None without any. NULL and NaN are left out.

    The column is saved once, so that the rounds of ``nth_values`` do not compute it again.
    """
    path = scratch_path(scores.sparkSession, "scores")
    scores.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)").write.parquet(path)
    saved = scores.sparkSession.read.parquet(path)
    n = saved.count()
    if not n:
        return None
    places = sorted({(n - 1) // 2, n // 2})
    found = nth_values(saved, "x", places)
    return found[0] if len(found) == 1 or found[0] == found[1] else (found[0] + found[1]) / 2


def score_stats(scored: DataFrame, config: Config = DEFAULT, exact: bool = True) -> DataFrame:
    """One row: spread of final_score and how often each penalty applied.

    Nothing is rounded. The exact median runs a few small jobs when the frame is built (``exact_median``); otherwise it is
    Spark's approximate one.
    """
    s = F.col("final_score")
    middle = F.lit(exact_median(scored, "final_score")).cast("double") if exact else F.percentile_approx(s, 0.5, 10_000)
    return scored.agg(
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.avg(s).alias("mean_score"),
        middle.alias("median_score"),
        F.count_if(F.col("final_score") == 0).alias("n_zero"),
        F.count("*").alias("n_total"),
        F.count_if(is_honeypot(scored)).alias("n_honeypot"),
        F.count_if(is_closed(scored)).alias("n_not_open"),
        F.count_if(is_inactive(config)).alias("n_inactive"),
        F.count_if(is_unreliable(config)).alias("n_low_interview"),
    )
