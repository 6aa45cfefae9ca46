"""Registered queries of the operators, over their whole tables, with the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.llm import bitsliced, bytepairs, html, language, lexical, minhash, multiindex, packing, pieces, secrets, substring, tokenbin, turns

BYTE_BPE, BYTE_RANKS, PIECE_BPE, END_ID = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", 2
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = substring.dedup_substrings(docs.select("doc_id", "text"))
    cut = F.aggregate("cut_spans", F.lit(0), lambda acc, s: acc + s.end - s.start)
    return found.select("doc_id", "text", F.size("cut_spans").alias("n_cuts"), cut.alias("cut_bytes"), "cut_spans")


@_query("op2_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@_query("op3_token_files")
def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = tokenbin.write_token_files(_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), end_id=END_ID)
    return tokenbin.read_documents(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


TOP = 5


@_query("op4_exact_topk", f"""
    WITH rows AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
    )
    SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {TOP}
""")
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", bitsliced.quantised(F.col("embedding")).alias("vector"))
    return bitsliced.top_by_inner_product(rows, rows.where("vec_id % 50 = 0"), TOP)


@_query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    cut = packing.cut_documents(docs, tokenizer_file(BYTE_BPE), END_ID)
    return packing.pack_pieces(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@_query("op6_minhash_forest", r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), tokens AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words),
    runs AS (
        SELECT doc_id, x || ' ' || lead(x, 1) OVER d || ' ' || lead(x, 2) OVER d || ' ' || lead(x, 3) OVER d || ' ' || lead(x, 4) OVER d AS x
        FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
    ), sets AS (
        SELECT DISTINCT doc_id, x FROM runs WHERE x IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4
    ), shingles AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM sets),
    pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
    ), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id)
    SELECT reach.a AS doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id, reach.a = min(b) AS kept
    FROM reach LEFT JOIN sizes ON reach.a = sizes.doc_id GROUP BY reach.a
""")
def minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 85)


@_query("op7_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file(PIECE_BPE)
    found = pieces.encode_decode(_table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query("op8_embedding_dedup", """
    WITH RECURSIVE rows AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
        WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.95
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT reach.a AS vec_id, CAST(coalesce(any_value(counts.n), 0) AS BIGINT) AS n_links, min(reach.b) AS component_id, reach.a = min(reach.b) AS kept
    FROM reach LEFT JOIN counts ON reach.a = counts.a GROUP BY reach.a
""")
def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


@_query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k, *_ in secrets.KINDS], F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"), secrets.as_text(secrets.all_spans()).alias("spans"))


@_query("op10_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query("op11_conversation_repair")
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.damaged_report(_table(spark, sf_dir, "conversations"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@_query("op12_lexical_search", f"""
    WITH words AS (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
    counted AS (SELECT d, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
    totals AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nl FROM counted),
    tfs AS (SELECT d, x, count(*) AS tf FROM (SELECT d, unnest(w) AS x FROM counted) GROUP BY d, x),
    weights AS (SELECT x, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, totals GROUP BY x, nd),
    asked AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS x FROM benchmark) GROUP BY item_id, x),
    norms AS (SELECT d, doc_id, 25 + (75 * n * nd) // nl AS m FROM counted, totals),
    scored AS (
        SELECT item_id, d, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
        FROM asked JOIN weights USING (x) JOIN tfs USING (x) JOIN norms USING (d) GROUP BY item_id, d, doc_id
    )
    SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
    WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 10
""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op13_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = bytepairs.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_file(BYTE_RANKS), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
