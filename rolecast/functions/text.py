"""Text normalisation and the text built from profiles and postings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.scalars import strip, text_or

MAX_CHARS = 2048
# How often a skill name is repeated, by proficiency; any other value: once.
SKILL_REPEAT = {"expert": 3, "advanced": 2}


def clean_text(x: Column) -> Column:
    """Lower case, only ``a-z 0-9``, single spaces."""
    # Any run of other characters becomes one space, in a single pass.
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", " "))


def truncate_words(x: Column, limit: int = MAX_CHARS) -> Column:
    """At most ``limit`` characters, without a cut-off last word."""
    return F.when(F.length(x) <= limit, x).otherwise(
        F.regexp_replace(F.substring(x, 1, limit), r" [^ ]*$", "")
    )


def normalise_skill(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^a-z0-9 ]", " "))


def skill_match(a: Column, b: Column, mode: str = "substring") -> Column:
    """Do two already normalised skill names match?"""
    if mode == "exact":
        return a == b
    return a.contains(b) | b.contains(a)


def _joined(parts: Column) -> Column:
    """Join the non-empty parts of a text array by a space."""
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p != "", F.lit(False))), " ")


def _field(x: Column) -> Column:
    return clean_text(text_or(x, ""))


def candidate_text_blob(limit: int = MAX_CHARS, by_start_date: bool = False) -> Column:
    """The text of a profile that is encoded into a vector.

    The last three roles are taken by array position, or by start date with
    ``by_start_date``.
    """
    profile = F.col("profile")
    head = [
        _field(profile[name])
        for name in ("headline", "summary", "current_title", "current_industry")
    ]
    skills = F.flatten(
        F.transform(
            F.filter("skills", lambda s: text_or(s["name"], "") != ""),
            lambda s: F.array_repeat(clean_text(s["name"]), _repeat(s["proficiency"])),
        )
    )
    roles = F.col("career_history")
    if by_start_date:
        roles = F.transform(
            F.array_sort(
                F.transform(roles, lambda r, i: F.struct(r["start_date"], i, r.alias("role")))
            ),
            lambda r: r["role"],
        )
    last = F.slice(roles, F.greatest(F.size(roles) - 2, F.lit(1)), F.lit(3))
    careers = F.transform(
        last,
        lambda r: clean_text(F.concat(text_or(r["title"], ""), F.lit(" "), text_or(r["description"], ""))),
    )
    degrees = F.flatten(
        F.transform(
            "education", lambda e: F.array(_field(e["degree"]), _field(e["field_of_study"]))
        )
    )
    certificates = F.transform("certifications", lambda c: _field(c["name"]))
    parts = F.concat(F.array(*head, _joined(skills)), careers, F.array(_joined(degrees), _joined(certificates)))
    return truncate_words(_joined(parts), limit)


def _repeat(proficiency: Column) -> Column:
    times = F.lit(1)
    for level, n in SKILL_REPEAT.items():
        times = F.when(proficiency == level, n).otherwise(times)
    return times


def posting_text_blob(limit: int = MAX_CHARS) -> Column:
    """The text of a posting that is encoded into a vector.

    Expects title, description, responsibilities, required_skills and
    preferred_skills (arrays of ``{name, importance}``; a plain name has no
    importance and counts as required) and qualifications (array of
    ``{degree, field}``; plain text goes into ``degree``).
    """
    head = [_field(F.col(c)) for c in ("title", "description", "responsibilities")]
    skills = F.flatten(
        F.transform(
            F.filter(
                F.concat("required_skills", "preferred_skills"),
                lambda s: text_or(s["name"], "") != "",
            ),
            lambda s: F.array_repeat(
                clean_text(s["name"]),
                F.when(text_or(s["importance"], "required") == "required", 3).otherwise(2),
            ),
        )
    )
    qualifications = F.transform(
        "qualifications",
        lambda q: clean_text(F.concat_ws(" ", q["degree"], q["field"])),
    )
    parts = F.concat(F.array(*head, _joined(skills)), qualifications)
    return truncate_words(_joined(parts), limit)


def search_text() -> Column:
    """Everything searchable in a profile as one lower-case text."""
    profile = F.col("profile")

    def plain(x: Column) -> Column:
        return text_or(x, "")

    head = F.array(
        *[plain(profile[n]) for n in ("headline", "summary", "current_title", "current_industry")]
    )
    skills = F.transform("skills", lambda s: plain(s["name"]))
    roles = F.flatten(
        F.transform("career_history", lambda r: F.array(plain(r["title"]), plain(r["description"])))
    )
    fields = F.transform("education", lambda e: plain(e["field_of_study"]))
    return F.lower(F.array_join(F.concat(head, skills, roles, fields), " "))
