"""Profile scoring, fraud screening and ranking as Spark jobs.

Every function takes and returns DataFrames (or builds a Column), so the
parts compose with ``DataFrame.transform``.
"""

from rolecast.config import DEFAULT, Config, Penalties, ReasonThresholds, Retrieval, Tiers, Weights
from rolecast.operators.audit import audit, audit_honeypot_share
from rolecast.operators.encode import HashingEncoder, batch_embed
from rolecast.operators.features import feature_table
from rolecast.operators.posting import Posting, extract_fields, single_posting
from rolecast.operators.rank import dedupe_first, rank_all, rank_summary, rank_topk, rank_topk_narrow
from rolecast.operators.reason import add_reasoning
from rolecast.operators.retrieve import (
    cosine_topk,
    cosine_topk_by_posting,
    fetch_by_ids,
    fetch_from_store,
    keyword_topn,
    keyword_topn_by_posting,
    semantic_retrieve,
)
from rolecast.operators.skill import matched_skill_rows
from rolecast.operators.score import add_final_score, score_stats
from rolecast.operators.screen import flag_facts, flag_report, screen, validate_batch
from rolecast.operators.vector_store import stored_topk, write_vector_store
from rolecast.operators.tfidf import encode_tfidf, fit_tfidf
from rolecast.plans.flow import (
    build_and_write,
    build_ranking,
    build_vectors,
    embed_postings,
    format_ranked,
    load_and_rank,
    rank_for_postings,
    rank_profiles,
    rank_stored,
    retrieve_and_score,
    run_features,
)
from rolecast.session import ship
from rolecast.sources.postings import load_posting
from rolecast.sources.profiles import read_profiles, read_profiles_strict, read_rejected, write_profile_store, write_profiles
from rolecast.sources.tables import read_features, read_ranked_csv, write_features, write_ranked_csv
from rolecast.streaming.screening import first_lines, score_stream, screen_new_lines, screen_stream

__all__ = [name for name in dir() if not name.startswith("_")]
