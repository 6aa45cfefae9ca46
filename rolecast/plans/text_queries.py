"""Queries of text building, posting extraction and retrieval."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.functions import text as T
from rolecast.functions.vocabulary import POSTING_SKILLS
from rolecast.operators import encode as E
from rolecast.operators import posting as P
from rolecast.operators import retrieve as R
from rolecast.operators import tfidf as TI
from rolecast.operators import vector_store as VS
from rolecast.operators.posting import Posting
from rolecast.plans import flow
from rolecast.plans.bindings import CONFIG, POSTING_TEXT, _id, document_profiles, postings, table, vectors
from rolecast.plans.registry import ORACLES, query
from rolecast.session import scratch_path
from rolecast.sources import profiles as SP


def _clean(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _join(parts: str) -> str:
    return f"array_to_string(list_filter({parts}, lambda p: p <> ''), ' ')"


_CUT = "CASE WHEN length(t) <= 2048 THEN t ELSE regexp_replace(substr(t, 1, 2048), ' [^ ]*$', '') END"
_LINES = "lines AS (SELECT *, string_split(text, chr(10)) AS ls FROM documents)"

# -- text of profiles and postings ------------------------------------------

_BLOB = f"""
WITH {_LINES}, parts AS (
  SELECT doc_id, [{_clean('ls[1]')}, {_clean('text')}, {_clean('source')}, {_clean('lang')}] AS head,
    list_transform(list_filter(list_zip(ls, range(len(ls))), lambda x: string_split(x[1], ' ')[1] <> ''),
      lambda x: rtrim(repeat({_clean("string_split(x[1], ' ')[1]")} || ' ', CASE x[2] % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END))) AS skills,
    list_transform(ls[greatest(len(ls) - 2, 1):], lambda x: {_clean("string_split(x, ' ')[1] || ' ' || x")}) AS careers,
    [{_clean("'Degree ' || source")} || ' ' || {_clean('lang')}, {_clean("'Cert: ' || lang || '!'")}] AS tail
  FROM lines),
joined AS (SELECT doc_id, {_join(f"list_concat(list_concat(head, [{_join('skills')}]), list_concat(careers, tail))")} AS t FROM parts)
SELECT {_id('doc_id')} AS candidate_id, {_CUT} AS text FROM joined"""


@query("candidate_text_blob", _BLOB)
def candidate_text_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_profiles(table(spark, sf_dir, "documents")).select("candidate_id", T.candidate_text_blob().alias("text"))


_JD_BLOB = f"""
WITH joined AS (
  SELECT item_id, {_join(f"[{_clean('substr(text, 1, 30)')}, {_clean('text')}, {_clean("'Duty ' || text")}, 'python python python c c go go go', " + _clean("'BSc ' || CAST(item_id AS STRING) || ' Math/CS'") + "]")} AS t FROM benchmark)
SELECT item_id, {_CUT} AS text FROM joined"""


def _full_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(
        "item_id", "substr(text, 1, 30) AS title", "text AS description", "'Duty ' || text AS responsibilities",
        "array(named_struct('name', 'Python', 'importance', CAST(NULL AS STRING)), named_struct('name', 'C++', 'importance', 'nice')) AS required_skills",
        "array(named_struct('name', '', 'importance', 'required'), named_struct('name', 'Go', 'importance', 'required')) AS preferred_skills",
        "array(named_struct('degree', 'BSc ' || CAST(item_id AS STRING), 'field', 'Math/CS')) AS qualifications",
    )


@query("jd_text_blob", _JD_BLOB)
def jd_text_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full_postings(spark, sf_dir).select("item_id", T.posting_text_blob().alias("text"))


_SEARCH = f"""
WITH {_LINES}, searched AS (SELECT doc_id, lower(array_to_string(list_concat(
  list_concat([ls[1], text, source, lang], list_transform(ls, lambda x: string_split(x, ' ')[1])),
  list_concat(flatten(list_transform(ls, lambda x: [string_split(x, ' ')[1], x])), [lang])), ' ')) AS t FROM lines)"""


@query("search_text", f"{_SEARCH} SELECT {_id('doc_id')} AS candidate_id, md5(t) AS digest, length(t) AS n_chars FROM searched")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_profiles(table(spark, sf_dir, "documents")).select("candidate_id", T.search_text().alias("t"))
    return docs.select("candidate_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n_chars"))


# -- posting fields ---------------------------------------------------------

_DICT = "[" + ", ".join(f"'{s}'" for s in POSTING_SKILLS) + "]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FIELDS = rf"""
WITH post AS (SELECT doc_id AS posting_id, {POSTING_TEXT} AS t FROM documents),
part AS (SELECT *, {_STRIP.format(r"regexp_extract(t, '(?i)(?:job title|position|role)\s*[:\-]\s*([^\n]+)', 1)")} AS title,
  regexp_extract(t, '(?i)(\d+(?:\.\d+)?)\s*\+?\s*years?\s*(?:of)?\s*experience', 1) AS years,
  regexp_extract(t, '(?i)industry\s*[:\-]\s*([^\n]+)', 1) AS ind, regexp_extract(t, '(?i)sector\s*[:\-]\s*([^\n]+)', 1) AS sec,
  regexp_extract(t, '(?is)required skills?\s*[:\-](.*?)(?:preferred|nice[- ]to[- ]have|responsibilities|$)', 1) AS section FROM post),
items AS (SELECT *, list_filter({_DICT}, lambda s: contains(lower(t), lower(s))) AS found,
  list_filter(list_transform(regexp_extract_all(section, '[•\-\*]\s*([^\n]+)', 1), lambda b: {_STRIP.format("string_split(b, '(')[1]")}),
    lambda b: b <> '' AND len(string_split_regex(b, '\s+')) <= 4) AS bullets FROM part)
SELECT posting_id, title, CASE WHEN years = '' THEN 0.0e0 ELSE CAST(years AS DOUBLE) END AS min_experience_years,
  {_STRIP.format("CASE WHEN ind <> '' THEN ind ELSE sec END")} AS industry,
  array_to_string(list_concat(found, list_filter(bullets, lambda b: NOT list_contains(found, b))), '|') AS skills
FROM items"""


@query("jd_field_extract", _FIELDS)
def jd_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_fields(postings(spark, sf_dir)).select(
        "posting_id", "title", "min_experience_years", "industry", F.array_join("required_skills", "|").alias("skills"))


@query("jd_skill_list", """
SELECT posting_id, array_to_string(list_filter(list_concat(string_split(source, 'c'), [lang, '', upper(lang)]), lambda s: s <> ''), '|') AS skills
FROM (SELECT doc_id AS posting_id, * FROM documents)""")
def jd_skill_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    jd = table(spark, sf_dir, "documents")
    skills = P.skill_list(F.split("source", "c"), F.array(F.col("lang"), F.lit(""), F.upper("lang")))
    return jd.select(F.col("doc_id").alias("posting_id"), F.array_join(skills, "|").alias("skills"))


# -- keyword retrieval ------------------------------------------------------

_WORDS = ("the", "Rest", "go", "data", "RAG", "tion", "für", "le", "Go", "python")
_HITS = " + ".join(f"CAST(contains(t, lower('{w}')) AS INTEGER)" for w in _WORDS)


@query("keyword_hits", f"{_SEARCH} SELECT {_id('doc_id')} AS candidate_id, {_HITS} AS hits FROM searched")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = document_profiles(table(spark, sf_dir, "documents"))
    return docs.select("candidate_id", R.keyword_hits(T.search_text(), _WORDS).alias("hits"))


@query("keyword_topn", f"""{_SEARCH}
SELECT candidate_id, hits FROM (SELECT {_id('doc_id')} AS candidate_id, {_HITS} AS hits FROM searched)
WHERE hits >= 1 ORDER BY hits DESC, candidate_id LIMIT 500""")
def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_topn(document_profiles(table(spark, sf_dir, "documents")), _WORDS)


# Every benchmark text asks with its first words and pieces of words, some of them twice.
_ASKED = "list_concat(string_split(text, ' ')[1:8], [substr(text, 3, 4), substr(text, 9, 2), upper(string_split(text, ' ')[1]), ''])"


@query("keyword_topn_by_posting", f"""{_SEARCH},
asked AS (SELECT item_id AS posting_id, lower(unnest({_ASKED})) AS w FROM benchmark),
hit AS (SELECT posting_id, doc_id, count(*) AS hits FROM searched JOIN asked ON w <> '' AND contains(t, w) GROUP BY ALL)
SELECT posting_id, {_id('doc_id')} AS candidate_id, CAST(hits AS INTEGER) AS hits, CAST(row_number() OVER p AS INTEGER) AS position
FROM hit WHERE hits >= 2 WINDOW p AS (PARTITION BY posting_id ORDER BY hits DESC, doc_id) QUALIFY position <= 50""")
def keyword_topn_by_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(
        F.slice(F.split("text", " "), 1, 8), F.array(F.substring("text", 3, 4), F.substring("text", 9, 2), F.upper(F.split("text", " ")[0]), F.lit("")))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("posting_id"), words.alias("keywords"))
    return R.keyword_topn_by_posting(document_profiles(table(spark, sf_dir, "documents")), asked, 50, 2)


@query("keyword_topn_no_keywords", f"SELECT {_id('doc_id')} AS candidate_id, CAST(0 AS INTEGER) AS hits FROM documents ORDER BY doc_id LIMIT 500")
def keyword_topn_no_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keyword_topn(document_profiles(table(spark, sf_dir, "documents")), ())


# -- vectors ----------------------------------------------------------------

@query("batch_embed", f"""
WITH blob AS ({_BLOB}), words AS (SELECT candidate_id, unnest(string_split(text, ' ')) AS w FROM blob),
bucket AS (SELECT candidate_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
norm AS (SELECT candidate_id, sqrt(sum(n * n)) AS len FROM bucket GROUP BY 1)
SELECT candidate_id, dim, round(CAST(CAST(n / len AS FLOAT) AS DOUBLE), 5) AS weight FROM bucket JOIN norm USING (candidate_id)""")
def batch_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = document_profiles(table(spark, sf_dir, "documents")).select("candidate_id", T.candidate_text_blob().alias("text"))
    encoded = E.batch_embed(blobs, lambda: E.HashingEncoder(64))
    cells = encoded.select("candidate_id", F.posexplode("embedding").alias("dim", "w")).where("w <> 0")
    return cells.select("candidate_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("w").cast("double"), 5).alias("weight"))


@query("embed_query", f"""
WITH blob AS ({_JD_BLOB}), words AS (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM blob),
bucket AS (SELECT item_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS dim, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL),
norm AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM bucket GROUP BY 1)
SELECT item_id, dim, round(CAST(CAST(n / len AS FLOAT) AS DOUBLE), 5) AS weight FROM bucket JOIN norm USING (item_id)""")
def embed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = flow.embed_postings(_full_postings(spark, sf_dir), lambda: E.HashingEncoder(64), key="item_id")
    cells = encoded.select("item_id", F.posexplode("embedding").alias("dim", "w")).where("w <> 0")
    return cells.select("item_id", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("w").cast("double"), 5).alias("weight"))


_TERM_MODEL = f"""blob AS ({_BLOB}), word AS (SELECT candidate_id, unnest(string_split(text, ' ')) AS term FROM blob),
model AS (SELECT term, ln((1e0 + (SELECT count(*) FROM blob)) / (1e0 + count(DISTINCT candidate_id))) + 1 AS idf FROM word WHERE term <> '' GROUP BY term)"""


def _unit_terms(words: str, key: str) -> str:
    return f"""w AS (SELECT {key}, term, count(*) * any_value(idf) AS w FROM {words} JOIN model USING (term) GROUP BY ALL),
norm AS (SELECT {key}, sqrt(sum(w * w)) AS len FROM w GROUP BY {key})
SELECT {key}, term, round(w / len, 6) AS weight FROM w JOIN norm USING ({key})"""


def _cells(vectors_: DataFrame, key: str) -> DataFrame:
    return vectors_.select(key, F.explode("vector").alias("c")).select(key, "c.term", F.round("c.weight", 6).alias("weight"))


@query("batch_embed_tfidf", f"WITH {_TERM_MODEL}, {_unit_terms('word', 'candidate_id')}")
def batch_embed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of all profiles."""
    blobs = candidate_text_blob(spark, sf_dir)
    return _cells(TI.encode_tfidf(blobs, TI.fit_tfidf(blobs)), "candidate_id")


@query("embed_query_tfidf", f"WITH {_TERM_MODEL}, asked AS (SELECT item_id, unnest(string_split(text, ' ')) AS term FROM ({_JD_BLOB})), {_unit_terms('asked', 'item_id')}")
def embed_query_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of postings by the model of the profiles."""
    model = TI.fit_tfidf(candidate_text_blob(spark, sf_dir))
    return _cells(TI.encode_tfidf(jd_text_blob(spark, sf_dir), model, key="item_id"), "item_id")


@query("l2_normalise", """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS dim FROM embeddings),
t AS (SELECT vec_id, dim, CAST(x AS DOUBLE) * (vec_id % 5) AS x FROM v), n AS (SELECT vec_id, sqrt(sum(x * x)) AS len FROM t GROUP BY 1)
SELECT vec_id, dim, round(CASE WHEN len > 0 THEN x / len END, 6) AS x FROM t JOIN n USING (vec_id)""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5))
    unit = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(E.l2_normalise(scaled)).alias("dim", "x"))
    return unit.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 6).alias("x"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _unit_dot(a: str, b: str) -> str:
    return f"({_DOT.format(a=a, b=b)} / sqrt({_DOT.format(a=b, b=b)}))"


@query("cosine_topk", f"""
WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
s AS (SELECT {_id('vec_id')} AS candidate_id, round({_unit_dot('embedding', 'qe')}, 9) AS sim FROM embeddings, q)
SELECT candidate_id, round(sim, 6) AS similarity, CAST(row_number() OVER (ORDER BY sim DESC, candidate_id) AS INTEGER) AS position
FROM s QUALIFY position <= 100""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return R.cosine_topk(v, q, 100).select("candidate_id", F.round(F.round("similarity", 9), 6).alias("similarity"), "position")


# One query per label: the vector with the smallest id.
_LABEL_QUERIES = "SELECT CAST(label AS STRING) AS posting_id, min_by(embedding, vec_id) AS qe FROM embeddings GROUP BY label"


@query("cosine_topk_by_posting", f"""
WITH q AS ({_LABEL_QUERIES}),
s AS (SELECT posting_id, {_id('vec_id')} AS candidate_id, round({_unit_dot('embedding', 'qe')}, 9) AS sim FROM embeddings, q)
SELECT posting_id, candidate_id, round(sim, 6) AS similarity,
       CAST(row_number() OVER (PARTITION BY posting_id ORDER BY sim DESC, candidate_id) AS INTEGER) AS position
FROM s QUALIFY position <= 20""")
def cosine_topk_by_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    queries = v.groupBy(F.col("label").cast("string").alias("posting_id")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    found = R.cosine_topk_by_posting(v, queries, 20)
    return found.select("posting_id", "candidate_id", F.round(F.round("similarity", 9), 6).alias("similarity"), "position")


def _stored_vectors(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "vector-store")
    v = vectors(spark, sf_dir)
    VS.write_vector_store(v, path, v.select(F.size("embedding")).first()[0], block_rows=64)
    return path


@query("cosine_topk_skipping", ORACLES["cosine_topk"])
def cosine_topk_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a store whose blocks are read only where they can matter."""
    q = vectors(spark, sf_dir).where("vec_id = 0").select("embedding").first()[0]
    found, _ = VS.stored_topk(spark, _stored_vectors(spark, sf_dir), ["query"], np.array([q]), 100)
    return found.select("candidate_id", F.round(F.round("similarity", 9), 6).alias("similarity"), "position")


@query("cosine_topk_by_posting_skipping", ORACLES["cosine_topk_by_posting"])
def cosine_topk_by_posting_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = vectors(spark, sf_dir).groupBy(F.col("label").cast("string").alias("posting_id")).agg(F.min_by("embedding", "vec_id").alias("embedding")).collect()
    found, _ = VS.stored_topk(spark, _stored_vectors(spark, sf_dir), [r[0] for r in asked], np.array([r[1] for r in asked]), 20)
    return found.select("posting_id", "candidate_id", F.round(F.round("similarity", 9), 6).alias("similarity"), "position")


_RETRIEVED = f"""q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0),
s AS (SELECT {_id('vec_id')} AS candidate_id, round({_unit_dot('embedding', 'qe')}, 9) AS sim FROM embeddings, q),
hit AS (SELECT candidate_id, greatest(least(sim, 1), 0) AS semantic_score FROM s ORDER BY sim DESC, candidate_id LIMIT 300)"""


@query("semantic_retrieve", f"WITH {_RETRIEVED} SELECT candidate_id, round(semantic_score, 6) AS semantic_score FROM hit")
def semantic_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select("embedding").first()[0]
    return R.semantic_retrieve(v, q, 300).select("candidate_id", F.round(F.round("semantic_score", 9), 6).alias("semantic_score"))


@query("fetch_by_ids", f"""WITH {_RETRIEVED}
SELECT candidate_id, round(semantic_score, 6) AS semantic_score, n_chars, source
FROM (SELECT *, {_id('doc_id')} AS candidate_id FROM documents) JOIN hit USING (candidate_id)""")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    q = v.where("vec_id = 0").select("embedding").first()[0]
    docs = table(spark, sf_dir, "documents").selectExpr(f"{_id('doc_id')} AS candidate_id", "n_chars", "source")
    found = R.fetch_by_ids(docs, R.semantic_retrieve(v, q, 300).drop("position"))
    return found.select("candidate_id", F.round(F.round("semantic_score", 9), 6).alias("semantic_score"), "n_chars", "source")


@query("fetch_from_store", ORACLES["fetch_by_ids"])
def fetch_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a store in ranges of the id."""
    v, path = vectors(spark, sf_dir), scratch_path(spark, "profile-store")
    q = v.where("vec_id = 0").select("embedding").first()[0]
    SP.write_profile_store(table(spark, sf_dir, "documents").selectExpr(f"{_id('doc_id')} AS candidate_id", "n_chars", "source"), path)
    found = R.fetch_from_store(spark, path, R.semantic_retrieve(v, q, 300).drop("position"))
    return found.select("candidate_id", F.round(F.round("semantic_score", 9), 6).alias("semantic_score"), "n_chars", "source")


_MODE_POSTING = Posting(title="", skills=_WORDS, skill_keys=("python",), min_years=0.0, industry="")


@query("retrieval_mode", f"""WITH {_RETRIEVED}, kw AS ({_SEARCH.replace('WITH ', 'WITH ', 1)} SELECT {_id('doc_id')} AS candidate_id, {_HITS} AS hits FROM searched)
SELECT 'semantic' AS mode, candidate_id, round(CAST(semantic_score AS DECIMAL(24, 10)), 4) AS semantic_score FROM hit WHERE candidate_id IN (SELECT {_id('doc_id')} FROM documents)
UNION ALL (SELECT 'keyword', candidate_id, 0.0e0 FROM kw WHERE hits >= 1 ORDER BY hits DESC, candidate_id LIMIT 500)""")
def retrieval_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval and scoring with and without vectors at hand, the mode left open."""
    v, docs = vectors(spark, sf_dir), document_profiles(table(spark, sf_dir, "documents"))
    q = v.where("vec_id = 0").select("embedding").first()[0]
    named = lambda mode, found: found.select(F.lit(mode).alias("mode"), "candidate_id", "semantic_score")
    with_vectors = flow.retrieve_and_score(docs, _MODE_POSTING, v, q, top_n=300, config=CONFIG)
    return named("semantic", with_vectors).unionByName(named("keyword", flow.retrieve_and_score(docs, _MODE_POSTING, top_n=500, config=CONFIG)))
