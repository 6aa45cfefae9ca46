"""Skill score: how well the skills of a profile cover those of a posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import clip, number, text_or
from rolecast.functions.text import normalise_skill, skill_match
from rolecast.functions.vocabulary import FULL_SKILL_MONTHS, PROFICIENCY, SKILL_WEIGHTS
from rolecast.operators.containment import containing
from rolecast.operators.posting import Criteria
from rolecast.session import per_session


def matched_skills(skills: Column, keys: Column, mode: str = "substring") -> Column:
    """Skills with a name that matches a wanted key; ``key`` is added to each."""
    named = F.transform(
        F.filter(skills, lambda s: text_or(s["name"], "") != ""),
        lambda s: F.struct(
            s["name"].alias("name"),
            normalise_skill(s["name"]).alias("key"),
            s["proficiency"].alias("proficiency"),
            s["duration_months"].alias("duration_months"),
        ),
    )
    return F.filter(named, lambda s: F.exists(keys, lambda k: skill_match(s["key"], k, mode)))


def matched_skill_rows(profiles: DataFrame, postings: DataFrame, mode: str = "substring", profile_key: str = "ingest_ordinal", posting_key: str = "posting_id") -> DataFrame:
    """``(profile_key, posting_key, idx, name, key)``: the matched skills of every profile for every posting.

    The relational form of ``matched_skills`` for tables of both sides. ``postings`` has ``skill_keys``, already normalised. Distinct
    names and keys are matched once, either containing the other, and profiles and postings then meet by equal names; ``idx`` counts the named
    skills of a profile from 0.
    """
    named = profiles.select(profile_key, F.posexplode(F.filter("skills", lambda s: text_or(s["name"], "") != "")).alias("idx", "s")).select(
        profile_key, "idx", F.col("s.name").alias("name"), normalise_skill(F.col("s.name")).alias("key"))
    wanted = postings.select(posting_key, F.explode("skill_keys").alias("wanted")).distinct()
    if mode == "exact":
        return named.join(wanted, named["key"] == wanted["wanted"]).select(profile_key, posting_key, "idx", "name", "key")
    have, want = named.select("key").distinct(), wanted.select("wanted").distinct()
    wide = containing(have.select(F.col("key").alias("id"), F.col("key").alias("text")), want, needle="wanted").select(F.col("id").alias("key"), "wanted")
    narrow = containing(want.select(F.col("wanted").alias("id"), F.col("wanted").alias("text")), have, needle="key").select("key", F.col("id").alias("wanted"))
    pairs = wide.unionByName(narrow).distinct()
    # A posting may want several keys that match one name.
    by_posting = pairs.join(wanted, "wanted").select("key", posting_key).distinct()
    return named.join(by_posting, "key").select(profile_key, posting_key, "idx", "name", "key")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0))


def _level(proficiency: Column) -> Column:
    value = F.lit(0.0)
    for name, weight in PROFICIENCY.items():
        value = F.when(F.lower(proficiency) == name, weight).otherwise(value)
    return value


def add_skill_scores(df: DataFrame, criteria: Criteria, config: Config = DEFAULT) -> DataFrame:
    """Add the four skill components, skill_score and skill_error.

    The matched skills and the assessed names are built once per row in an
    earlier projection; the components read them.
    """
    inputs, components, score = _skill_columns(criteria, config)
    scored = df.withColumns(inputs).withColumns(components)
    return scored.withColumn("skill_score", score).drop(*inputs)


@per_session
def _skill_columns(criteria: Criteria, config: Config) -> tuple[dict[str, Column], dict[str, Column], Column]:
    assessed = F.transform(
        F.filter(
            F.coalesce(
                F.map_entries(F.col("signals")["skill_assessment_scores"]),
                F.array().cast("array<struct<key:string,value:string>>"),
            ),
            lambda e: number(e["value"]).isNotNull(),
        ),
        lambda e: F.struct(normalise_skill(e["key"]).alias("key"), (number(e["value"]) / 100.0).alias("value")),
    )
    inputs = {
        "_matched": matched_skills(F.col("skills"), criteria.skill_keys, config.skill_matching),
        "_assessed": assessed,
    }
    matched = F.col("_matched")
    wanted = F.size(criteria.skill_keys)
    # Two assessments may share a normalised name: the last one counts.
    results = F.filter(
        F.transform(
            matched,
            lambda s: F.try_element_at(
                F.filter(F.col("_assessed"), lambda a: a["key"] == s["key"]), F.lit(-1)
            )["value"],
        ),
        lambda v: v.isNotNull(),
    )
    months = F.transform(matched, lambda s: F.coalesce(number(s["duration_months"]), F.lit(0.0)))
    components = {
        "skill_direct": F.coalesce(F.least(F.try_divide(F.size(matched), wanted), F.lit(1.0)), F.lit(0.0)),
        "skill_proficiency": _mean(F.transform(matched, lambda s: _level(s["proficiency"]))),
        "skill_assessment": _mean(results),
        "skill_duration": F.least(_mean(months) / FULL_SKILL_MONTHS, F.lit(1.0)),
        # A duration that is present but not numeric.
        "skill_error": F.exists(
            matched,
            lambda s: (text_or(s["duration_months"], "") != "") & number(s["duration_months"]).isNull(),
        ),
    }
    total = F.lit(0.0)
    for name, weight in SKILL_WEIGHTS.items():
        total = total + weight * F.col(f"skill_{name}")
    return inputs, components, F.when(wanted > 0, clip(total)).otherwise(0.0)
