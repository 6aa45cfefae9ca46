"""Postings: field extraction from text, and the view the scorers need."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rolecast.functions.scalars import number, strip, text_or
from rolecast.functions.text import normalise_skill
from rolecast.functions.vocabulary import POSTING_SKILLS
from rolecast.session import per_session

# Fixed patterns. ``[^\n]`` is used for "any character of the line".
_TITLE = r"(?i)(?:job title|position|role)\s*[:\-]\s*([^\n]+)"
_YEARS = r"(?i)(\d+(?:\.\d+)?)\s*\+?\s*years?\s*(?:of)?\s*experience"
_INDUSTRY = (r"(?i)industry\s*[:\-]\s*([^\n]+)", r"(?i)sector\s*[:\-]\s*([^\n]+)")
_SECTION = (
    r"(?is)required skills?\s*[:\-](.*?)"
    r"(?:preferred|nice[- ]to[- ]have|responsibilities|$)"
)
_BULLET = r"[•\-\*]\s*([^\n]+)"
_MAX_BULLET_WORDS = 4


def dictionary_skills(low: Column, word_boundary: bool = False) -> Column:
    """Dictionary entries found in a lower-case text, in dictionary order.

    A plain substring test, so short entries are found nearly everywhere;
    ``word_boundary`` asks for whole words.
    """
    def found(skill: str) -> Column:
        if word_boundary:
            return low.rlike(rf"(?<![a-z0-9]){re.escape(skill.lower())}(?![a-z0-9])")
        return low.contains(skill.lower())

    return F.array_compact(F.array(*[F.when(found(s), F.lit(s)) for s in POSTING_SKILLS]))


def bullet_skills(text: Column) -> Column:
    """Short bullet items of the "required skills:" section, notes removed."""
    section = F.regexp_extract(text, _SECTION, 1)
    items = F.transform(
        F.regexp_extract_all(section, F.lit(_BULLET), F.lit(1)),
        lambda b: strip(F.substring_index(strip(b), "(", 1)),
    )
    return F.filter(
        items,
        lambda b: (b != "") & (F.size(F.split(b, r"\s+")) <= _MAX_BULLET_WORDS),
    )


def extract_fields(postings: DataFrame, text_column: str = "text", word_boundary: bool = False) -> DataFrame:
    """Title, minimum years, industry and skills from the text of each posting."""
    # Texts and captures are a projection of their own, computed once per row
    # although later columns read them several times.
    source = postings.withColumn("_text", text_or(F.col(text_column), ""))
    text = F.col("_text")
    source = source.withColumns(
        {
            "_low": F.lower(text),
            "_years": F.regexp_extract(text, _YEARS, 1),
            "_industry": F.regexp_extract(text, _INDUSTRY[0], 1),
            "_sector": F.regexp_extract(text, _INDUSTRY[1], 1),
        }
    )
    return source.withColumns(
        {
            "title": strip(F.regexp_extract(text, _TITLE, 1)),
            "required_skills": F.array_distinct(
                F.concat(dictionary_skills(F.col("_low"), word_boundary), bullet_skills(text))
            ),
            "preferred_skills": F.array().cast("array<string>"),
            "min_experience_years": F.coalesce(number(F.col("_years")), F.lit(0.0)),
            "industry": strip(F.when(F.col("_industry") != "", F.col("_industry")).otherwise(F.col("_sector"))),
            "description": text,
        }
    ).drop("_text", "_low", "_years", "_industry", "_sector")


def skill_list(required: Column, preferred: Column) -> Column:
    """Required then preferred names, without empty entries."""
    none = F.array().cast("array<string>")
    return F.filter(
        F.concat(F.coalesce(required, none), F.coalesce(preferred, none)),
        lambda s: F.coalesce(s != "", F.lit(False)),
    )


@dataclass(frozen=True, eq=False)  # hashed by identity: columns have no equality
class Criteria:
    """What the scorers read from a posting, as columns."""

    skill_keys: Column
    min_years: Column
    industry: Column


@dataclass(frozen=True)
class Posting:
    """One posting as plain values; small by nature, one record."""

    title: str = ""
    skills: tuple[str, ...] = ()
    skill_keys: tuple[str, ...] = ()
    min_years: float = 0.0
    industry: str = ""
    description: str = ""
    # What is encoded: the fields of a structured posting, or the file name and text of another.
    encoded: dict | None = field(default=None, compare=False, hash=False)

    @staticmethod
    def from_row(row: Row) -> "Posting":
        return Posting(
            title=row["title"],
            skills=tuple(row["skills"]),
            skill_keys=tuple(row["skill_keys"]),
            min_years=float(row["min_years"]),
            industry=row["industry"],
            description=row["description"],
        )

    def criteria(self) -> Criteria:
        return _criteria(self)


@per_session
def _criteria(posting: Posting) -> Criteria:
    keys = F.array(*[F.lit(k) for k in posting.skill_keys]).cast("array<string>")
    return Criteria(keys, F.lit(posting.min_years), F.lit(posting.industry))


def with_criteria(postings: DataFrame) -> DataFrame:
    """Add ``skills``, ``skill_keys``, ``min_years`` in the form scorers need."""
    skills = skill_list(F.col("required_skills"), F.col("preferred_skills"))
    return postings.withColumns(
        {
            "title": text_or(F.col("title"), ""),
            "industry": text_or(F.col("industry"), ""),
            "description": text_or(F.col("description"), ""),
            "min_years": F.coalesce(number(F.col("min_experience_years")), F.lit(0.0)),
            "skills": skills,
            "skill_keys": F.transform(skills, normalise_skill),
        }
    )


def single_posting(postings: DataFrame) -> Posting:
    """The one record of a posting frame as plain values."""
    rows = with_criteria(postings).select(
        "title", "skills", "skill_keys", "min_years", "industry", "description"
    ).take(2)
    if len(rows) != 1:
        raise ValueError("expected exactly one posting")
    return Posting.from_row(rows[0])


@per_session
def joined_criteria() -> Criteria:
    """Criteria from the columns of a frame already joined with postings."""
    return Criteria(F.col("posting_skill_keys"), F.col("posting_min_years"), F.col("posting_industry"))
