"""Profiles for the tests, with only the fields that rules and scores read."""

from __future__ import annotations

import json


def role(title="Backend Engineer", company="Acme", start="2020-01-01", end=None, months=12, current=None, industry="Software",
         description="Built software systems and data services for several clients."):
    return {"title": title, "company": company, "start_date": start, "end_date": end, "duration_months": months,
            "is_current": end is None if current is None else current, "industry": industry, "description": description}


def skill(name, proficiency="intermediate", endorsements=5, months=20):
    return {"name": name, "proficiency": proficiency, "endorsements": endorsements, "duration_months": months}


def degree(start=2017, end=2020, tier="tier_3", name="B.E."):
    return {"institution": "A College", "degree": name, "field_of_study": "Computer Science", "start_year": start,
            "end_year": end, "tier": tier}


def signals(**changes):
    base = {
        "profile_completeness_score": 60, "signup_date": "2024-06-01", "last_active_date": "2026-04-01",
        "open_to_work_flag": True, "applications_submitted_30d": 3, "recruiter_response_rate": 0.2,
        "avg_response_time_hours": 48, "skill_assessment_scores": {}, "notice_period_days": 30,
        "expected_salary_range_inr_lpa": {"min": 20, "max": 35}, "github_activity_score": 10,
        "search_appearance_30d": 30, "saved_by_recruiters_30d": 2, "interview_completion_rate": 0.5,
        "offer_acceptance_rate": -1, "verified_email": True, "verified_phone": False,
    }
    return {**base, **changes}


def profile(cid="CAND_0000009", years=6.0, title="Backend Engineer", headline="Engineer", **parts):
    """A profile without flags; ``parts`` replace whole sections."""
    base = {
        "candidate_id": cid,
        "profile": {"headline": headline, "summary": "Works with data.", "years_of_experience": years,
                    "current_title": title, "current_industry": "Software"},
        "career_history": [role(months=60, start="2021-03-01")],
        "education": [degree()], "skills": [skill("SQL")], "certifications": [], "signals": signals(),
    }
    return {**base, **parts}


VALID = profile(
    "CAND_0000001", 6.9,
    career_history=[
        role(company="Mindtree", start="2024-03-08", months=27, industry="IT Services"),
        role("Analytics Engineer", "Dunder Mifflin", "2019-07-03", "2024-01-08", 55, industry="Paper Products"),
    ],
    skills=[skill("NLP", "advanced", 37, 26), skill("Python", "advanced", 21, 36), skill("SQL", "intermediate", 9, 40)],
    signals=signals(
        profile_completeness_score=86.9, signup_date="2025-10-16", last_active_date="2026-05-20",
        recruiter_response_rate=0.34, avg_response_time_hours=177.8, skill_assessment_scores={"NLP": 38.8},
        notice_period_days=60, github_activity_score=9.2, search_appearance_30d=249, saved_by_recruiters_30d=4,
        interview_completion_rate=0.71, offer_acceptance_rate=0.58, verified_phone=True),
)
HONEYPOT = profile(
    "CAND_HONEY01", 1.0, "Senior AI Architect",
    career_history=[role("Senior AI Architect", "FakeCo", "2025-06-01", months=12, industry="AI/ML", description="Led all AI initiatives.")],
    education=[degree(2020, 2024, "tier_1")],
    skills=[skill(f"Skill {i}", "expert", 100 - 10 * i, 0) for i in range(10)],
    signals=signals(
        profile_completeness_score=95, signup_date="2025-01-01", last_active_date="2026-05-01", recruiter_response_rate=0.9,
        avg_response_time_hours=12, notice_period_days=0, github_activity_score=90, search_appearance_30d=200,
        saved_by_recruiters_30d=15, interview_completion_rate=1.0, offer_acceptance_rate=1.0, verified_phone=True),
)
SUSPICIOUS = profile(
    "CAND_SUSP001", 2.5, "Director of Engineering",
    career_history=[
        role("Director of Engineering", "StartupXYZ", "2025-06-01", months=12, description="Leading teams that are building data systems."),
        role("Junior Intern", "BigCorp", "2024-01-01", "2025-05-01", 16),
    ],
    education=[degree(2020, 2024, "tier_4")],
    skills=[skill("Python", "intermediate", 5, 20), skill("JavaScript", "beginner", 2, 10)],
)
PLANTED = profile(
    "CAND_SUSP002", 2.0, "Senior Director",
    career_history=[
        role("Senior Director", "Co", "2025-06-01", months=12, description="Leading engineering team."),
        role("Junior Trainee", "OldCo", "2024-06-01", "2025-05-01", 11, description="Basic testing tasks."),
    ],
    education=[degree(2020, 2024)], skills=[skill("Magic", "beginner", 100, 0)],
    certifications=[{"name": "Future Cert", "issuer": "X", "year": 2030}],
    signals=signals(signup_date="2026-03-01", last_active_date="2025-01-01"),
)


def load(spark, tmp_path, *profiles, name="profiles.jsonl"):
    """The profiles through the JSON reader, as in production."""
    from rolecast.sources.profiles import read_profiles

    path = tmp_path / name
    path.write_text("\n".join(json.dumps(p) for p in profiles), encoding="utf-8")
    return read_profiles(spark, str(path))
