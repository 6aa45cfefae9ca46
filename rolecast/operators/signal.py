"""Signal score: availability, responsiveness, credibility, demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import clip, days_inactive, number, parse_date, safe_float, text_or
from rolecast.functions.vocabulary import MAX_SAVES, MAX_SEARCHES, SIGNAL_WEIGHTS
from rolecast.session import per_session

# Fixed step tables: (upper bound, score), then the score beyond the last one.
RECENCY_STEPS = ((30, 1.0), (90, 0.8), (180, 0.5))
NOTICE_STEPS = ((30, 1.0), (60, 0.8), (90, 0.6), (120, 0.4))
RESPONSE_STEPS = ((24, 1.0), (72, 0.8), (120, 0.6), (168, 0.4))
BEYOND = 0.2

# Numeric fields a bad value of which makes the whole row unscorable.
NUMERIC_FIELDS = (
    "notice_period_days", "recruiter_response_rate", "avg_response_time_hours",
    "interview_completion_rate", "profile_completeness_score", "offer_acceptance_rate",
    "saved_by_recruiters_30d", "search_appearance_30d", "github_activity_score",
)


def _steps(x: Column, table: tuple[tuple[int, float], ...]) -> Column:
    bound, score = table[0]
    ladder = F.when(x <= bound, score)
    for bound, score in table[1:]:
        ladder = ladder.when(x <= bound, score)
    return ladder.otherwise(BEYOND)


def _yes(x: Column, no: float = 0.0) -> Column:
    return F.when(x, 1.0).otherwise(no)


def availability(s: Column, config: Config = DEFAULT) -> Column:
    days = days_inactive(parse_date(s["last_active_date"]), config.reference_date)
    return (
        0.4 * _yes(s["open_to_work_flag"], 0.4)
        + 0.4 * _steps(days, RECENCY_STEPS)
        + 0.2 * _steps(safe_float(s["notice_period_days"]), NOTICE_STEPS)
    )


def responsiveness(s: Column) -> Column:
    return (
        0.4 * clip(safe_float(s["recruiter_response_rate"]))
        + 0.3 * _steps(safe_float(s["avg_response_time_hours"]), RESPONSE_STEPS)
        + 0.3 * clip(safe_float(s["interview_completion_rate"]))
    )


def credibility(s: Column) -> Column:
    accepted = number(s["offer_acceptance_rate"])
    return (
        0.25 * _yes(s["verified_email"])
        + 0.25 * _yes(s["verified_phone"])
        + 0.30 * clip(safe_float(s["profile_completeness_score"]) / 100.0)
        + 0.20 * F.when(accepted >= 0, F.least(accepted, F.lit(1.0))).otherwise(0.5)
    )


def github_activity(s: Column) -> Column:
    """Code activity in [0, 1]; no account counts as none."""
    return clip(safe_float(s["github_activity_score"]) / 100.0)


def market_demand(s: Column) -> Column:
    return (
        0.4 * F.least(safe_float(s["saved_by_recruiters_30d"]) / MAX_SAVES, F.lit(1.0))
        + 0.3 * F.least(safe_float(s["search_appearance_30d"]) / MAX_SEARCHES, F.lit(1.0))
        + 0.3 * github_activity(s)
    )


def add_signal_scores(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add the four signal components and signal_score."""
    components, score = _signal_columns(config)
    return df.withColumns(components).withColumn("signal_score", score)


@per_session
def _signal_columns(config: Config) -> tuple[dict[str, Column], Column]:
    s = F.col("signals")
    components = {
        "signal_availability": availability(s, config),
        "signal_responsiveness": responsiveness(s),
        "signal_credibility": credibility(s),
        "signal_market_demand": market_demand(s),
    }
    total = F.lit(0.0)
    for name, weight in SIGNAL_WEIGHTS.items():
        total = total + weight * F.col(f"signal_{name}")
    return components, clip(total)


@per_session
def bad_signal() -> Column:
    """Is a numeric signal, or the last active date, present but malformed?"""
    s = F.col("signals")
    bad = (text_or(s["last_active_date"], "") != "") & parse_date(s["last_active_date"]).isNull()
    for name in NUMERIC_FIELDS:
        bad = bad | ((text_or(s[name], "") != "") & number(s[name]).isNull())
    return bad
