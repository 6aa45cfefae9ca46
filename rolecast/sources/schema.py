"""The profile schema.

Scalars that a rule may find malformed are read as text and cast with
``try_cast`` where they are used: a typed leaf would turn a bad value into
NULL, and "invalid" could no longer be told from "missing".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.scalars import truth

CORRUPT = "_corrupt_record"

_PROFILE = (
    "anonymized_name STRING, headline STRING, summary STRING, location STRING, country STRING, "
    "years_of_experience STRING, current_title STRING, current_company STRING, "
    "current_company_size STRING, current_industry STRING"
)
_ROLE = (
    "company STRING, title STRING, start_date STRING, end_date STRING, duration_months STRING, "
    "is_current BOOLEAN, industry STRING, company_size STRING, description STRING"
)
_EDUCATION = (
    "institution STRING, degree STRING, field_of_study STRING, start_year STRING, "
    "end_year STRING, grade STRING, tier STRING"
)
_SKILL = "name STRING, proficiency STRING, endorsements STRING, duration_months STRING"
_CERTIFICATE = "name STRING, issuer STRING, year STRING"
_LANGUAGE = "language STRING, proficiency STRING"
_SIGNALS = (
    "profile_completeness_score STRING, signup_date STRING, last_active_date STRING, "
    "open_to_work_flag BOOLEAN, profile_views_received_30d STRING, "
    "applications_submitted_30d STRING, recruiter_response_rate STRING, "
    "avg_response_time_hours STRING, skill_assessment_scores MAP<STRING,STRING>, "
    "connection_count STRING, endorsements_received STRING, notice_period_days STRING, "
    "expected_salary_range_inr_lpa STRUCT<min: STRING, max: STRING>, "
    "preferred_work_mode STRING, willing_to_relocate BOOLEAN, github_activity_score STRING, "
    "search_appearance_30d STRING, saved_by_recruiters_30d STRING, "
    "interview_completion_rate STRING, offer_acceptance_rate STRING, verified_email BOOLEAN, "
    "verified_phone BOOLEAN, linkedin_connected BOOLEAN"
)
# Types as DDL text, so that importing this module needs no session.
PARTS: dict[str, str] = {
    "profile": f"STRUCT<{_PROFILE}>",
    "career_history": f"ARRAY<STRUCT<{_ROLE}>>",
    "education": f"ARRAY<STRUCT<{_EDUCATION}>>",
    "skills": f"ARRAY<STRUCT<{_SKILL}>>",
    "certifications": f"ARRAY<STRUCT<{_CERTIFICATE}>>",
    "languages": f"ARRAY<STRUCT<{_LANGUAGE}>>",
    "signals": f"STRUCT<{_SIGNALS}>",
}
ARRAYS = ("career_history", "education", "skills", "certifications", "languages")


def _flags(fields: str) -> list[str]:
    return [f.split(" ")[0] for f in fields.split(", ") if f.endswith(" BOOLEAN")]


def with_booleans(df: DataFrame) -> DataFrame:
    """Turn the yes-no fields, read as text, into booleans; any number but 0 is true."""

    def flag(x: Column) -> Column:
        # JSON's own words first: as a number each would cost an exception.
        other = truth(x) | F.coalesce(x.try_cast("double") != 0, F.lit(False))
        return F.when(x == "true", True).when(x == "false", False).otherwise(other)

    def converted(record: Column, names: list[str]) -> Column:
        for name in names:
            record = record.withField(name, flag(record[name]))
        return record

    return df.withColumns({
        "career_history": F.transform("career_history", lambda role: converted(role, _flags(_ROLE))),
        "signals": converted(F.col("signals"), _flags(_SIGNALS)),
    })


def normalise_arrays(df: DataFrame) -> DataFrame:
    """Replace missing arrays by empty ones and drop null elements."""
    kinds = dict(df.dtypes)

    def full(name: str) -> Column:
        empty = F.array().cast(kinds[name])
        return F.filter(F.coalesce(F.col(name), empty), lambda x: x.isNotNull())

    return df.withColumns({name: full(name) for name in ARRAYS if name in kinds})


def reading_order() -> Column:
    """Position of a row in the files it is read from: file, split, row.

    For a frame just read from files, before any shuffle.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
