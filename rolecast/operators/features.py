"""The feature table: everything the final score and the reasons read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import days_inactive, number, parse_date, stable_round
from rolecast.operators.career import add_career_scores, bad_career_number
from rolecast.operators.posting import Criteria
from rolecast.operators.screen import UNKNOWN_ID, screen
from rolecast.operators.signal import add_signal_scores, bad_signal, github_activity
from rolecast.operators.skill import add_skill_scores
from rolecast.session import per_session

# Columns carried along when the input has them.
CARRIED = ("posting_id", "ingest_ordinal")


def feature_table(
    profiles: DataFrame,
    criteria: Criteria,
    config: Config = DEFAULT,
    reason_columns: bool = True,
) -> DataFrame:
    """Score and screen each profile. Row-local: no shuffle.

    A row with a malformed number or activity date gets zero scores and
    neutral penalty inputs (``scoring_error``); it is still screened.
    """
    scored = add_signal_scores(
        add_career_scores(add_skill_scores(profiles, criteria, config), criteria), config
    )
    judged = screen(scored, config).withColumn(
        "scoring_error", F.col("skill_error") | bad_career_number() | bad_signal()
    )
    order = dict(profiles.dtypes).get("ingest_ordinal", "")
    columns = _output_columns("semantic_score" in profiles.columns, reason_columns, order.split("<")[0], config)
    return judged.select(*columns, *[c for c in CARRIED if c in profiles.columns])


def _unknown_id(order: str) -> Column:
    """A name of its own for a profile without an id: ``UNKNOWN_`` and its reading position.

    ``order`` is the type of ``ingest_ordinal``; without that column the plain word remains.
    """
    place = F.col("ingest_ordinal")
    if order == "struct":
        place = F.concat_ws("_", F.sha2(place["file"], 256), place["block"].cast("string"), place["line"].cast("string"))
    return F.concat(F.lit(f"{UNKNOWN_ID}_"), place.cast("string")) if order else F.lit(UNKNOWN_ID)


@per_session
def _output_columns(has_semantic: bool, reason_columns: bool, order: str, config: Config) -> list[Column]:
    signals, error = F.col("signals"), F.col("scoring_error")

    def unless_error(value: Column, default: float | bool | int) -> Column:
        return F.when(error, F.lit(default)).otherwise(value)

    rate = number(signals["interview_completion_rate"])
    if config.zero_interview_is_missing:
        rate = F.when(rate != 0, rate)
    semantic = F.col("semantic_score") if has_semantic else F.lit(0.0)
    days = days_inactive(parse_date(signals["last_active_date"]), config.reference_date)
    columns = [
        F.coalesce(F.col("candidate_id"), _unknown_id(order)).alias("candidate_id"),
        stable_round(semantic, 4).alias("semantic_score"),
        *[
            stable_round(unless_error(F.col(c), 0.0), 4).alias(c)
            for c in ("skill_score", "career_score", "signal_score")
        ],
        F.col("is_honeypot"),
        unless_error(F.coalesce(signals["open_to_work_flag"], F.lit(True)), True).alias("open_to_work"),
        unless_error(days, 999).alias("days_inactive"),
        stable_round(unless_error(F.coalesce(rate, F.lit(1.0)), 1.0), 4).alias("interview_completion_rate"),
        F.col("risk_score"),
        F.col("validation_tier"),
        error,
    ]
    if reason_columns:
        columns += [
            F.filter(F.transform("skills", lambda s: s["name"]), lambda n: n.isNotNull()).alias("skills"),
            number(F.col("profile")["years_of_experience"]).alias("years_experience"),
            github_activity(signals).alias("github_activity"),
            F.col("signal_responsiveness").alias("responsiveness"),
            F.col("profile")["current_title"].alias("current_title"),
            F.get("education", F.lit(0))["degree"].alias("education_level"),
        ]
    return columns
