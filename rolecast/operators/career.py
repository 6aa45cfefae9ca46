"""Career score: experience, seniority, tenure, sector and education."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.scalars import clip, contains_any, number, safe_float, strip, text_or
from rolecast.functions.vocabulary import (
    CAREER_WEIGHTS,
    JUNIOR_TITLES,
    SCHOOL_TIER,
    SCHOOL_TIER_OTHER,
    SENIOR_TITLES,
)
from rolecast.operators.posting import Criteria
from rolecast.session import per_session

# Fixed score levels.
_NO_HISTORY_LEVEL = 0.3
_OLDEST = "0000-00-00"


def experience(years: Column, required: Column) -> Column:
    have, need = F.greatest(years, F.lit(0.0)), F.greatest(required, F.lit(0.0))
    return F.when(need > 0, F.least(have / need, F.lit(1.0))).otherwise(F.when(have > 0, 1.0).otherwise(0.5))


def latest_title(roles: Column) -> Column:
    """Title of the current role, else of the one that started last.

    Of equal ones the first in the array counts; a missing start sorts oldest.
    """
    keyed = F.transform(
        roles,
        lambda r, i: F.struct(
            F.coalesce(r["is_current"], F.lit(False)).alias("current"),
            text_or(r["start_date"], _OLDEST).alias("start"),
            (-i).alias("order"),
            text_or(r["title"], "").alias("title"),
        ),
    )
    return F.array_max(keyed)["title"]


def progression(roles: Column) -> Column:
    title = latest_title(roles)
    return (
        F.when(F.size(roles) == 0, _NO_HISTORY_LEVEL)
        .when(contains_any(title, SENIOR_TITLES), 1.0)
        .when(contains_any(title, JUNIOR_TITLES), 0.2)
        .otherwise(0.6)
    )


def tenure(roles: Column) -> Column:
    months = F.filter(F.transform(roles, lambda r: safe_float(r["duration_months"])), lambda m: m > 0)
    mean = F.try_divide(F.aggregate(months, F.lit(0.0), lambda acc, m: acc + m), F.size(months))
    return (
        F.when(mean.isNull(), 0.5)
        .when(mean < 6, 0.1)
        .when(mean < 12, 0.5)
        .when(mean <= 36, 1.0)
        .otherwise(0.8)
    )


def industry_match(roles: Column, wanted: Column) -> Column:
    want = F.lower(strip(wanted))

    def same(r: Column) -> Column:
        have = F.lower(strip(text_or(r["industry"], "")))
        return have.contains(want) | want.contains(have)

    now = F.exists(roles, lambda r: F.coalesce(r["is_current"], F.lit(False)) & same(r))
    return (
        F.when((text_or(wanted, "") == "") | (F.size(roles) == 0), 0.2)
        .when(now, 1.0)
        .when(F.exists(roles, same), 0.6)
        .otherwise(0.2)
    )


def education_level(education: Column) -> Column:
    def worth(e: Column) -> Column:
        value = F.lit(SCHOOL_TIER_OTHER)
        for tier, score in SCHOOL_TIER.items():
            value = F.when(F.lower(strip(text_or(e["tier"], ""))) == tier, score).otherwise(value)
        return value

    return F.coalesce(F.array_max(F.transform(education, worth)), F.lit(SCHOOL_TIER_OTHER))


def add_career_scores(df: DataFrame, criteria: Criteria) -> DataFrame:
    """Add the five career components and career_score."""
    components, score = _career_columns(criteria)
    return df.withColumns(components).withColumn("career_score", score)


@per_session
def _career_columns(criteria: Criteria) -> tuple[dict[str, Column], Column]:
    roles = F.col("career_history")
    years = safe_float(F.col("profile")["years_of_experience"])
    components = {
        "career_experience": experience(years, criteria.min_years),
        "career_progression": progression(roles),
        "career_tenure": tenure(roles),
        "career_industry": industry_match(roles, criteria.industry),
        "career_education": education_level(F.col("education")),
    }
    total = F.lit(0.0)
    for name, weight in CAREER_WEIGHTS.items():
        total = total + weight * F.col(f"career_{name}")
    return components, clip(total)


@per_session
def bad_career_number() -> Column:
    """Are the years or a role's months present but not numeric?"""
    years = F.col("profile")["years_of_experience"]
    bad_years = (text_or(years, "") != "") & number(years).isNull()
    return bad_years | F.exists(
        "career_history",
        lambda r: (text_or(r["duration_months"], "") != "") & number(r["duration_months"]).isNull(),
    )
