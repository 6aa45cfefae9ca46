"""The word lists, tables and limits that define the results."""

# Titles, for the career score and the impossible-profile rules.
SENIOR_TITLES = (
    "senior", "lead", "principal", "head", "director", "manager", "chief", "vp",
    "vice president", "architect", "staff", "fellow",
)
JUNIOR_TITLES = ("junior", "intern", "internship", "trainee", "associate", "assistant", "entry")

# Titles, for the behavioural rules. On purpose not the lists above.
JUMP_SENIOR_TITLES = (
    "senior", "lead", "principal", "director", "vp", "vice president", "chief",
    "architect", "head", "staff", "fellow",
)
JUMP_JUNIOR_TITLES = ("intern", "trainee", "junior", "associate", "assistant", "entry")

TECHNICAL_TITLES = (
    "engineer", "developer", "architect", "scientist", "programmer", "coder",
    "devops", "sre", "mlops",
)
TECHNICAL_CONTENT = (
    "code", "system", "data", "build", "deploy", "api", "model", "software",
    "algorithm", "database", "server", "cloud", "pipeline", "architecture",
    "framework", "testing", "debug", "infrastructure", "machine learning",
    "neural", "training",
)

# Skill names looked for in the text of a posting.
POSTING_SKILLS = (
    "Python", "Java", "JavaScript", "TypeScript", "Go", "Rust", "C++", "C#",
    "Ruby", "PHP", "Swift", "Kotlin", "Scala", "TensorFlow", "PyTorch", "Keras",
    "scikit-learn", "XGBoost", "Machine Learning", "Deep Learning", "NLP",
    "Computer Vision", "SQL", "PostgreSQL", "MySQL", "MongoDB", "Redis",
    "Elasticsearch", "Spark", "Kafka", "Airflow", "dbt", "Hadoop", "AWS", "GCP",
    "Azure", "Docker", "Kubernetes", "Terraform", "React", "Angular", "Vue",
    "Node.js", "FastAPI", "Flask", "Django", "MLOps", "Data Engineering",
    "Feature Engineering", "Pandas", "NumPy", "Matplotlib", "Seaborn", "FAISS",
    "LangChain", "RAG", "LLM", "Transformers", "Git", "CI/CD", "Linux", "REST",
    "GraphQL", "Power BI", "Tableau", "Excel", "R", "MATLAB", "Statistics",
    "A/B Testing",
)

PROFICIENCY = {"beginner": 0.25, "intermediate": 0.50, "advanced": 0.75, "expert": 1.00}
SCHOOL_TIER = {"tier_1": 1.00, "tier_2": 0.75, "tier_3": 0.50}
SCHOOL_TIER_OTHER = 0.25

SKILL_WEIGHTS = {"direct": 0.40, "proficiency": 0.25, "assessment": 0.20, "duration": 0.15}
CAREER_WEIGHTS = {
    "experience": 0.30, "progression": 0.25, "tenure": 0.20, "industry": 0.15, "education": 0.10,
}
SIGNAL_WEIGHTS = {
    "availability": 0.35, "responsiveness": 0.30, "credibility": 0.20, "market_demand": 0.15,
}

FULL_SKILL_MONTHS = 36.0
MAX_SAVES = 20.0
MAX_SEARCHES = 300.0
MIN_WORKING_AGE = 16
SCHOOL_START_AGE = 18
LAST_CERTIFICATE_YEAR = 2026
