"""Fraud screen: a registry of additive rules over one profile.

Every rule is a column expression that yields either one nullable flag or an
array of flags. ``add_flags`` evaluates the whole registry in one projection;
the order of the registry is the order of the flags, which decides the
primary reason among flags of equal points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.config import DEFAULT, Config
from rolecast.functions.scalars import (
    blank,
    contains_any,
    months_between_30,
    number,
    parse_date,
    safe_float,
    strip,
    text_or,
    whole,
    whole_text,
)
from rolecast.functions.vocabulary import (
    JUMP_JUNIOR_TITLES,
    JUMP_SENIOR_TITLES,
    LAST_CERTIFICATE_YEAR,
    MIN_WORKING_AGE,
    SCHOOL_START_AGE,
    SENIOR_TITLES,
    TECHNICAL_CONTENT,
    TECHNICAL_TITLES,
)
from rolecast.session import per_session

FLAG_TYPE = "struct<name:string,points:int,description:string>"
CLEAN_REASON = "Clean profile"
UNKNOWN_ID = "UNKNOWN"


# -- shared inputs ----------------------------------------------------------

def prepare(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add the parsed arrays that several rules read.

    They are separate projections on purpose: the optimiser keeps a
    projection apart when its expensive columns are used more than once, so
    each array is parsed once per row.
    """
    parsed, sorted_ = _prepared_columns(config)
    return df.withColumns(parsed).withColumns(sorted_)


def _level(skill: Column) -> Column:
    return F.lower(text_or(skill["proficiency"], ""))


def _amount(x: Column) -> Column:
    return F.coalesce(whole(x), F.lit(0))


@per_session
def _prepared_columns(config: Config) -> tuple[dict[str, Column], dict[str, Column]]:
    reference = F.lit(config.reference_date)
    profile = F.col("profile")
    parsed = (
        {
            "_years": number(profile["years_of_experience"]),
            "_title": text_or(profile["current_title"], ""),
            "_roles": F.transform(
                "career_history",
                lambda r, i: F.struct(
                    (i + 1).alias("nr"),
                    r["company"].alias("company"),
                    r["title"].alias("title"),
                    r["start_date"].alias("start_text"),
                    r["end_date"].alias("end_text"),
                    parse_date(r["start_date"]).alias("start"),
                    parse_date(r["end_date"]).alias("end"),
                    whole(r["duration_months"]).alias("months"),
                    F.coalesce(r["is_current"], F.lit(False)).alias("current"),
                    F.lower(text_or(r["description"], "")).alias("description"),
                ),
            ),
            # Only the skills that some rule looks at; in the others nothing can be wrong.
            "_skills": F.transform(
                F.filter("skills", lambda s: _level(s).isin("expert", "advanced") | ((_amount(s["duration_months"]) == 0) & (_amount(s["endorsements"]) > 50))),
                lambda s: F.struct(
                    s["name"].alias("name"),
                    _level(s).alias("level"),
                    _amount(s["duration_months"]).alias("months"),
                    _amount(s["endorsements"]).alias("endorsements"),
                ),
            ),
            "_first_school_year": F.array_min(F.transform("education", lambda e: whole(e["start_year"]))),
        }
    )
    sorted_ = (
        {
            "_role_keys": F.transform(
                "_roles",
                lambda r: F.when(
                    ~(blank(r["company"]) | blank(r["title"]) | blank(r["start_text"])),
                    F.struct(
                        F.lower(strip(r["company"])).alias("company"),
                        F.lower(strip(r["title"])).alias("title"),
                        strip(r["start_text"]).alias("start"),
                    ),
                ),
            ),
            "_by_start": F.array_sort(
                F.transform(
                    "_roles",
                    lambda r: F.struct(
                        text_or(r["start_text"], "0000-00-00").alias("key"),
                        r["nr"].alias("nr"),
                        text_or(r["title"], "").alias("title"),
                        r["start"].alias("start"),
                        r["end"].alias("end"),
                        F.coalesce(r["months"], F.lit(0)).alias("months"),
                    ),
                )
            ),
            "_spans": F.array_sort(
                F.transform(
                    F.filter("_roles", lambda r: r["start"].isNotNull()),
                    lambda r: F.struct(
                        r["start"].alias("start"),
                        r["nr"].alias("nr"),
                        F.coalesce(r["end"], reference).alias("end"),
                        text_or(r["title"], "Unknown").alias("title"),
                    ),
                )
            ),
            "_career_months": F.aggregate(
                "_roles",
                F.lit(0).cast("bigint"),
                lambda acc, r: acc + F.coalesce(r["months"], F.lit(0).cast("bigint")),
            ),
        }
    )
    return parsed, sorted_


# -- building blocks --------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A rule of the screen. ``many`` rules yield an array of flags."""

    names: tuple[str, ...]
    build: Callable[[Config], Column]
    many: bool = False


def flag(name: str | Column, points: int | Column, *description: str | Column) -> Column:
    parts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in description]
    return F.struct(
        (F.lit(name) if isinstance(name, str) else name).alias("name"),
        (F.lit(points) if isinstance(points, int) else points).cast("int").alias("points"),
        F.concat(*parts).alias("description"),
    )


def first_of(flags: Column) -> Column:
    """The first non-null flag of an array, NULL when there is none."""
    return F.get(F.array_compact(flags), F.lit(0))


def _known(x: Column) -> Column:
    return text_or(x, "Unknown")


# Descriptions below are fixed output texts.

# -- structural rules -------------------------------------------------------

def _missing_id(config: Config) -> Column:
    return F.when(text_or(F.col("candidate_id"), "") == "",
                  flag("missing_candidate_id", 10, "Missing candidate_id field"))


def _missing_field(field: str) -> Callable[[Config], Column]:
    def build(config: Config) -> Column:
        return F.when(blank(F.col("profile")[field]),
                      flag(f"missing_profile_{field}", 10, f"Missing critical profile field: {field}"))
    return build


def _no_history(config: Config) -> Column:
    return F.when(F.size("career_history") == 0,
                  flag("empty_career_history", 10, "Career history is empty — no work experience records"))


def _years_range(config: Config) -> Column:
    raw, years = F.col("profile")["years_of_experience"], F.col("_years")
    return (
        F.when(years < 0, flag("negative_experience", 20, "Negative years of experience: ", years))
        .when(years > 50, flag("excessive_experience", 20, "Unrealistic years of experience: ", years, " (>50 years)"))
        .when(raw.isNotNull() & years.isNull(),
              flag("invalid_experience_value", 10, "years_of_experience is not a valid number"))
    )


def _role_dates(config: Config) -> Column:
    def of_role(r: Column) -> Column:
        nr, start, end = r["nr"], r["start_text"], r["end_text"]
        place = (_known(r["title"]), " at ", _known(r["company"]))
        return F.array(
            F.when(r["months"] < 0,
                   flag("negative_duration", 15, "Negative duration_months (", r["months"],
                        ") in career role ", nr, ": ", *place)),
            F.when((text_or(start, "") != "") & r["start"].isNull(),
                   flag("invalid_start_date", 10, "Invalid start_date format in career role ", nr, ": '", start, "'")),
            F.when((text_or(end, "") != "") & r["end"].isNull(),
                   flag("invalid_end_date", 10, "Invalid end_date format in career role ", nr, ": '", end, "'")),
            F.when(r["end"] < r["start"],
                   flag("end_before_start", 15, "end_date (", end, ") before start_date (", start,
                        ") in career role ", nr, ": ", *place)),
        )
    return F.flatten(F.transform("_roles", of_role))


def _school_years(config: Config) -> Column:
    def of_degree(e: Column) -> Column:
        start, end = whole(e["start_year"]), whole(e["end_year"])
        return F.when(end < start,
                      flag("education_year_inverted", 10, "Education end_year (", end,
                           ") before start_year (", start, ") at ", _known(e["institution"])))
    return F.transform("education", of_degree)


def _duplicate_role(config: Config) -> Column:
    keys = F.col("_role_keys")

    def of_role(r: Column, i: Column) -> Column:
        # The first position of an equal key lies before this role.
        seen = F.array_position(keys, F.get(keys, i)) <= i
        return F.when(seen, flag("duplicate_career_entry", 15, "Duplicate career entry: ", r["title"],
                                 " at ", r["company"], " starting ", r["start_text"]))
    return F.transform("_roles", of_role)


def _salary(config: Config) -> Column:
    salary = F.col("signals")["expected_salary_range_inr_lpa"]
    return F.when(number(salary["min"]) > number(salary["max"]),
                  flag("salary_range_inverted", 5, "Salary range inverted: min (", salary["min"],
                       ") > max (", salary["max"], ") LPA"))


# -- impossible profiles ----------------------------------------------------

def _expert(limit: int) -> Column:
    return F.size(F.filter("_skills", lambda s: (s["level"] == "expert") & (s["months"] <= limit)))


def _expert_zero(config: Config) -> Column:
    n = F.size(F.filter("_skills", lambda s: (s["level"] == "expert") & (s["months"] == 0)))
    return F.when(n > 0, flag("expert_skill_zero_duration", F.least(n * 30, F.lit(60)), n,
                              " expert skill(s) with 0 months duration — impossible proficiency claim"))


def _mass_expert(config: Config) -> Column:
    n = _expert(3)
    return F.when(n >= 8, flag("mass_expert_near_zero", 40, n,
                               " expert skills with ≤3 months usage — bulk fake proficiency claims"))


def _claim_known() -> Column:
    return (F.size("career_history") > 0) & (F.col("_years") > 0)


def _sum_exceeds_claim(config: Config) -> Column:
    total, claimed = F.col("_career_months"), F.col("_years") * 12
    return F.when(_claim_known() & (total > claimed * 1.5) & (total > 24),
                  flag("experience_sum_exceeds_claimed", 25, "Career duration sum (", total,
                       " months) vastly exceeds claimed experience (", whole_text(claimed), " months)"))


def _claim_exceeds_sum(config: Config) -> Column:
    total, claimed = F.col("_career_months"), F.col("_years") * 12
    return F.when(_claim_known() & (claimed > total * 3) & (claimed > 24),
                  flag("claimed_exceeds_career_sum", 25, "Claimed experience (", whole_text(claimed),
                       " months) vastly exceeds career history sum (", total, " months)"))


def _future_start(config: Config) -> Column:
    return first_of(F.transform("_roles", lambda r: F.when(
        r["start"] > F.lit(config.reference_date),
        flag("future_start_date", 20, "Career role ", r["nr"], " starts in the future (",
             r["start_text"], ") — impossible"))))


def _underage(config: Config) -> Column:
    birth = F.col("_first_school_year") - SCHOOL_START_AGE
    known = F.col("_first_school_year") < 9999
    return first_of(F.transform("_roles", lambda r: F.when(
        known & (F.year(r["start"]) < birth + MIN_WORKING_AGE),
        flag("underage_work_start", 20, "Career role ", r["nr"], " starts in ", F.year(r["start"]),
             ", but candidate likely born ~", birth, f" (working before age {MIN_WORKING_AGE})"))))


def _senior_newcomer(config: Config) -> Column:
    # Missing years count as none; unreadable years disable the rule.
    years, title = F.coalesce(F.col("_years"), _zero_if_absent()), F.col("_title")
    return F.when((years <= 1) & contains_any(title, SENIOR_TITLES),
                  flag("senior_title_trivial_experience", 35, "Senior-level title '", title, "' with only ",
                       years, " year(s) experience — impossible progression"))


def _zero_if_absent() -> Column:
    raw = F.col("profile")["years_of_experience"]
    return F.when(text_or(raw, "") == "", 0.0)


def _longer_than_span(config: Config) -> Column:
    def of_role(r: Column) -> Column:
        span = months_between_30(r["start"], r["end"])
        return F.when((r["months"] > 0) & (r["months"] > span + 6),
                      flag("duration_exceeds_timespan", 20, "Role ", r["nr"], " claims ", r["months"],
                           " months but date range spans only ~", whole_text(span), " months"))
    return first_of(F.transform("_roles", of_role))


def _too_many_skills(config: Config) -> Column:
    n = F.size(F.filter("_skills", lambda s: s["level"].isin("expert", "advanced")))
    return F.when(n > 20, flag("skill_count_explosion", 25, n,
                               " skills at expert/advanced level — unrealistic breadth of mastery"))


def _assessment(config: Config) -> Column:
    scores = F.map_entries(F.col("signals")["skill_assessment_scores"])

    def of_skill(s: Column) -> Column:
        low = F.get(
            F.filter(scores, lambda e: (F.lower(strip(e["key"])) == F.lower(strip(text_or(s["name"], ""))))
                     & (number(e["value"]) < 20)),
            F.lit(0),
        )
        return F.when((s["level"] == "expert") & low.isNotNull(),
                      flag("assessment_contradiction", 20, "Skill '", text_or(s["name"], ""),
                           "' marked expert but assessment score is only ", low["value"], "/100"))
    return first_of(F.transform("_skills", of_skill))


def _overlap(config: Config) -> Column:
    spans = F.col("_spans")

    def of_role(a: Column, i: Column) -> Column:
        # Spans are sorted by start, so of all later roles longer than the
        # tolerated overlap the first one begins earliest: if that one does not
        # overlap enough, no later one does.
        b = F.get(
            F.filter(spans, lambda x, j: (j > i) & (F.datediff(x["end"], x["start"]) > 30)),
            F.lit(0),
        )
        days = F.datediff(F.least(a["end"], b["end"]), b["start"])
        return F.when(days > 30,
                      flag("overlapping_careers", 15, "Career roles overlap by ", days, " days: '",
                           a["title"], "' and '", b["title"], "'"))
    return first_of(F.transform(spans, of_role))


# -- behaviour --------------------------------------------------------------

def _jump(config: Config) -> Column:
    ordered = F.col("_by_start")

    def of_role(r: Column, i: Column) -> Column:
        following = F.get(ordered, i + 1)
        waited = r["months"] + months_between_30(r["end"], following["start"])
        return F.when(
            contains_any(r["title"], JUMP_JUNIOR_TITLES)
            & contains_any(following["title"], JUMP_SENIOR_TITLES)
            & (waited < 24),
            flag("suspicious_career_jump", 20, "Suspicious jump from '", r["title"], "' to '",
                 following["title"], "' in <2 years — unrealistic progression"),
        )
    return first_of(F.transform(ordered, of_role))


def _growth(config: Config) -> Column:
    years, title = F.coalesce(F.col("_years"), _zero_if_absent()), F.col("_title")
    return F.when((years < 3) & contains_any(title, JUMP_SENIOR_TITLES),
                  flag("unrealistic_growth", 15, "Only ", years, " years experience but holds senior title '",
                       title, "'"))


def _bot(config: Config) -> Column:
    s = F.col("signals")
    sent = F.coalesce(whole(s["applications_submitted_30d"]), F.lit(0))
    silent = (safe_float(s["recruiter_response_rate"]) == 0) & (safe_float(s["interview_completion_rate"]) == 0)
    return F.when((sent > 20) & silent,
                  flag("fake_activity_pattern", 15, "Submitted ", sent,
                       " applications but 0% response rate and 0% interview completion — bot-like behavior"))


def _endorsed_unused(config: Config) -> Column:
    return first_of(F.transform("_skills", lambda s: F.when(
        (s["months"] == 0) & (s["endorsements"] > 50),
        flag("endorsement_anomaly", 10, "Skill '", _known(s["name"]), "' has ", s["endorsements"],
             " endorsements but 0 months experience — fake endorsements"))))


def _complete_but_empty(config: Config) -> Column:
    complete = safe_float(F.col("signals")["profile_completeness_score"])
    return F.when((complete > 90) & (F.size("skills") == 0) & (F.size("career_history") == 0),
                  flag("completeness_content_mismatch", 20, "Profile completeness is ", complete,
                       "% but has 0 skills and empty career history — data inconsistency"))


def _active_first(config: Config) -> Column:
    active, signup = F.col("signals")["last_active_date"], F.col("signals")["signup_date"]
    return F.when(parse_date(active) < parse_date(signup),
                  flag("active_before_signup", 15, "Last active (", active, ") before signup (", signup,
                       ") — impossible timeline"))


def _certificates(config: Config) -> Column:
    earliest = F.when(F.col("_first_school_year") != 0, F.col("_first_school_year"))

    def of_certificate(c: Column) -> Column:
        year, subject = whole(c["year"]), ("Certification '", _known(c["name"]), "' year ")
        return (
            F.when(year > LAST_CERTIFICATE_YEAR, flag("future_certification", 10, *subject, year, " is in the future"))
            .when(year < earliest, flag("premature_certification", 10, *subject, year,
                                        " is before education start (", earliest, ")"))
        )
    return first_of(F.transform("certifications", of_certificate))


def _wrong_description(config: Config) -> Column:
    role = F.coalesce(
        F.get(F.filter("_roles", lambda r: r["current"]), F.lit(0)),
        F.get(F.col("_roles"), F.lit(0)),
    )
    text, title = role["description"], text_or(role["title"], "")
    return F.when(contains_any(title, TECHNICAL_TITLES) & (F.length(text) > 50)
                  & ~contains_any(text, TECHNICAL_CONTENT),
                  flag("title_description_mismatch", 10, "Technical title '", title,
                       "' but role description contains no technical keywords — possible fake title"))


STRUCTURAL: tuple[Rule, ...] = (
    Rule(("missing_candidate_id",), _missing_id),
    Rule(("missing_profile_headline",), _missing_field("headline")),
    Rule(("missing_profile_years_of_experience",), _missing_field("years_of_experience")),
    Rule(("missing_profile_current_title",), _missing_field("current_title")),
    Rule(("empty_career_history",), _no_history),
    Rule(("negative_experience", "excessive_experience", "invalid_experience_value"), _years_range),
    Rule(("negative_duration", "invalid_start_date", "invalid_end_date", "end_before_start"), _role_dates, many=True),
    Rule(("education_year_inverted",), _school_years, many=True),
    Rule(("duplicate_career_entry",), _duplicate_role, many=True),
    Rule(("salary_range_inverted",), _salary),
)
IMPOSSIBLE: tuple[Rule, ...] = (
    Rule(("expert_skill_zero_duration",), _expert_zero),
    Rule(("mass_expert_near_zero",), _mass_expert),
    Rule(("experience_sum_exceeds_claimed",), _sum_exceeds_claim),
    Rule(("claimed_exceeds_career_sum",), _claim_exceeds_sum),
    Rule(("future_start_date",), _future_start),
    Rule(("underage_work_start",), _underage),
    Rule(("senior_title_trivial_experience",), _senior_newcomer),
    Rule(("duration_exceeds_timespan",), _longer_than_span),
    Rule(("skill_count_explosion",), _too_many_skills),
    Rule(("assessment_contradiction",), _assessment),
    Rule(("overlapping_careers",), _overlap),
)
BEHAVIOUR: tuple[Rule, ...] = (
    Rule(("suspicious_career_jump",), _jump),
    Rule(("unrealistic_growth",), _growth),
    Rule(("fake_activity_pattern",), _bot),
    Rule(("endorsement_anomaly",), _endorsed_unused),
    Rule(("completeness_content_mismatch",), _complete_but_empty),
    Rule(("active_before_signup",), _active_first),
    Rule(("future_certification", "premature_certification"), _certificates),
    Rule(("title_description_mismatch",), _wrong_description),
)
ALL_RULES: tuple[Rule, ...] = STRUCTURAL + IMPOSSIBLE + BEHAVIOUR


# -- public operators -------------------------------------------------------

@per_session
def _rule_results(rules: tuple[Rule, ...], config: Config) -> Column:
    groups = []
    for rule in rules:
        built = rule.build(config)
        groups.append(built if rule.many else F.array(built))
    return F.concat(*groups)


def _raised(results: Column) -> Column:
    # Lambdas are interpreted with all they are given. Named more than once, the results stay a projection of their own, which is compiled.
    return F.when(F.size(results) > 0, F.array_compact(results)).otherwise(results).cast(f"array<{FLAG_TYPE}>")


def add_flags(df: DataFrame, config: Config = DEFAULT, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """Add ``flags``, the ordered array of ``{name, points, description}``."""
    helpers_before = set(df.columns)
    results = _rule_results(tuple(rules), config)
    flagged = prepare(df, config).withColumn("_results", results).withColumn("flags", _raised(F.col("_results")))
    return flagged.drop(*[c for c in flagged.columns if c.startswith("_") and c not in helpers_before])


def risk_score(flags: Column, config: Config = DEFAULT) -> Column:
    total = F.aggregate(flags, F.lit(0), lambda acc, f: acc + f["points"])
    return F.least(total, F.lit(config.tiers.cap))


def risk_tier(risk: Column, config: Config = DEFAULT) -> Column:
    return (
        F.when(risk >= config.tiers.honeypot, "honeypot")
        .when(risk >= config.tiers.suspicious, "suspicious")
        .otherwise("clean")
    )


def primary_reason(flags: Column) -> Column:
    """Description of the first flag with the most points."""
    most = F.array_max(F.transform(flags, lambda f: f["points"]))
    top = F.get(F.filter(flags, lambda f: f["points"] == most), F.lit(0))
    return F.coalesce(top["description"], F.lit(CLEAN_REASON))


def penalty_multiplier(tier: Column, config: Config = DEFAULT) -> Column:
    return (
        F.when(tier == "honeypot", config.penalties.honeypot_multiplier)
        .when(tier == "suspicious", config.tiers.suspicious_multiplier)
        .otherwise(1.0)
    )


def screen(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add flags, risk_score, validation_tier, is_honeypot and primary_reason.

    Write the verdicts before filtering on them: Spark moves a filter below a
    projection by copying its expressions, which would run the rules twice.
    """
    scored = add_flags(df, config).withColumn("risk_score", risk_score(F.col("flags"), config))
    tiered = scored.withColumns(
        {
            "validation_tier": risk_tier(F.col("risk_score"), config),
            "primary_reason": primary_reason(F.col("flags")),
        }
    )
    return tiered.withColumn("is_honeypot", F.col("validation_tier") == "honeypot")


def validate_batch(df: DataFrame, config: Config = DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """The verdict table: one row per profile, flag names joined by a comma; behind them the columns to ``keep``."""
    return screen(df, config).select(
        text_or(F.col("candidate_id"), UNKNOWN_ID).alias("candidate_id"),
        "is_honeypot",
        "risk_score",
        F.col("validation_tier").alias("tier"),
        "primary_reason",
        F.array_join(F.transform("flags", lambda f: f["name"]), ", ").alias("flags"),
        *keep,
    )


def flag_facts(df: DataFrame, config: Config = DEFAULT, rules: Sequence[Rule] = ALL_RULES) -> DataFrame:
    """One row per flag raised, with its position in the profile's flags."""
    # The outer form keeps the optimiser from adding a filter on the array below
    # the generator, which would evaluate all rules once more.
    flagged = add_flags(df, config, rules).select(
        text_or(F.col("candidate_id"), UNKNOWN_ID).alias("candidate_id"),
        F.posexplode_outer("flags").alias("position", "flag"),
    )
    return flagged.where(F.col("position").isNotNull()).select(
        "candidate_id", "position", "flag.name", "flag.points", "flag.description"
    )


def flag_report(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Number of flags and points per rule."""
    return flag_facts(df, config).groupBy("name").agg(
        F.count("*").alias("n_flags"), F.sum("points").alias("total_points")
    )
