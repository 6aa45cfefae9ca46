"""Reasons: one readable sentence per row, from the columns that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import coerce_bool, safe_numeric, safe_value, strip, whole_text

# The texts below are fixed output.


def skills_fragment(df: DataFrame, config: Config = DEFAULT) -> list[Column]:
    raw = safe_value(df, "skills")
    if raw is None:
        return []
    if dict(df.dtypes)["skills"] == "string":
        names = F.filter(F.transform(F.split(raw, ","), strip), lambda s: s != "")
    else:
        names = F.transform(F.filter(raw, lambda s: s != ""), lambda s: strip(s.cast("string")))
    limit = config.reasons.max_skills
    shown = F.array_join(F.slice(names, 1, limit), ", ")
    more = F.when(F.size(names) > limit, F.concat(F.lit(" (+"), (F.size(names) - limit).cast("string"), F.lit(" more)")))
    return [F.when(F.size(names) > 0, F.concat(F.lit("strong "), shown, F.coalesce(more, F.lit("")), F.lit(" background")))]


def experience_fragments(df: DataFrame, config: Config = DEFAULT) -> list[Column]:
    out = []
    years = safe_numeric(df, "years_experience")
    if years is not None:
        y = years.cast("bigint")
        text = F.concat(y.cast("string"), F.lit(" years experience"))
        out.append(F.when(y >= config.reasons.strong_years, text).when(y > 0, F.concat(text, F.lit(" (early career)"))))
    if "current_title" in df.columns:
        title = strip(F.col("current_title"))
        out.append(F.when(title != "", F.concat(F.lit("currently "), title)))
    return out


def education_fragment(df: DataFrame) -> list[Column]:
    if "education_level" not in df.columns:
        return []
    level = strip(F.col("education_level"))
    return [F.when(level != "", F.concat(level, F.lit(" education")))]


def component_fragments(df: DataFrame, config: Config = DEFAULT) -> list[Column]:
    t = config.reasons
    table = (
        ("semantic_score", t.semantic, "excellent profile-to-job semantic match"),
        ("skill_score", t.skill, "highly relevant skill set"),
        ("career_score", t.career, "strong career progression"),
        ("signal_score", t.signal, "positive engagement signals"),
    )
    return [F.when(safe_numeric(df, c) >= limit, F.lit(text)) for c, limit, text in table if c in df.columns]


def signal_fragments(df: DataFrame, config: Config = DEFAULT) -> list[Column]:
    out = []
    if "github_activity" in df.columns:
        out.append(F.when(safe_numeric(df, "github_activity") >= config.reasons.github, F.lit("high GitHub activity")))
    if "open_to_work" in df.columns:
        is_open = coerce_bool(df, "open_to_work")
        out.append(F.when(is_open, F.lit("open to work")).when(~is_open, F.lit("not currently marked as open to work")))
    if "responsiveness" in df.columns:
        out.append(F.when(safe_numeric(df, "responsiveness") >= config.reasons.responsiveness, F.lit("highly responsive")))
    return out


def penalty_fragments(df: DataFrame, config: Config = DEFAULT) -> list[Column]:
    out = []
    if "is_honeypot" in df.columns:
        out.append(F.when(coerce_bool(df, "is_honeypot"), F.lit("⚠ flagged as honeypot (score zeroed)")))
    days = safe_numeric(df, "days_inactive")
    if days is not None:
        text = F.concat(F.lit("inactive for "), days.cast("bigint").cast("string"), F.lit(" days (penalty applied)"))
        out.append(F.when(days > config.penalties.inactive_days, text))
    rate = safe_numeric(df, "interview_completion_rate")
    if rate is not None:
        text = F.concat(F.lit("low interview completion rate ("), whole_text(rate * 100), F.lit("%, penalty applied)"))
        out.append(F.when(rate < config.penalties.interview_rate, text))
    return out


def sentence(fragments: list[Column]) -> Column:
    """Fragments joined by commas, first letter upper case, full stop."""
    body = F.concat_ws(", ", *fragments)
    return F.when(body == "", "").otherwise(
        F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 2**31 - 1), F.lit("."))
    )


def add_reasoning(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    fragments = [
        *skills_fragment(df, config),
        *experience_fragments(df, config),
        *education_fragment(df),
        *component_fragments(df, config),
        *signal_fragments(df, config),
        *penalty_fragments(df, config),
    ]
    return df.withColumn("reasoning", sentence(fragments) if fragments else F.lit(""))


def blank_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("reasoning") == "").alias("n_blank"), F.count("*").alias("n_total"))
