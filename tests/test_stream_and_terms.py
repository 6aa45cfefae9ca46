"""First lines of a stream, sparse vectors, and ranking from a stored table."""

import datetime as dt
import json
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rolecast.operators import tfidf as TI
from rolecast.operators.posting import Posting
from rolecast.operators.score import add_final_score
from rolecast.operators.features import feature_table
from rolecast.operators.screen import validate_batch
from rolecast.plans import flow, source_queries
from rolecast.plans.bindings import profiles
from rolecast.sources.profiles import read_profiles
from rolecast.streaming.screening import first_lines, screen_new_lines, to_parquet
from samples import HONEYPOT, SUSPICIOUS, VALID, load, profile


def test_the_first_line_of_each_id_stays(spark, tmp_path):
    lines = tmp_path / "in"
    lines.mkdir()
    a, b, c = json.dumps(VALID), json.dumps(HONEYPOT), json.dumps(SUSPICIOUS)
    later = json.dumps({**VALID, "profile": {**VALID["profile"], "headline": ""}})
    nobody = json.dumps({**VALID, "candidate_id": None})
    batches = [[a, later, b, nobody, "not json"], [later, c, json.dumps({**HONEYPOT, "skills": []}), nobody], [c, a]]
    for k, batch in enumerate(batches):
        (lines / f"{k}.txt").write_text("\n".join(batch))
        stream = spark.readStream.schema("value string").text(str(lines))
        to_parquet(screen_new_lines(stream), str(tmp_path / "rows"), str(tmp_path / "state")).start().awaitTermination()
    found = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).collect())
    (tmp_path / "want.jsonl").write_text("\n".join([a, b, c, nobody, nobody]))
    assert found == sorted(tuple(r) for r in validate_batch(read_profiles(spark, str(tmp_path / "want.jsonl"))).collect())
    stream = spark.readStream.schema("value string").text(str(lines))
    to_parquet(first_lines(stream), str(tmp_path / "first"), str(tmp_path / "s2")).start().awaitTermination()
    kept = [r.value for r in spark.read.parquet(str(tmp_path / "first")).collect()]
    assert sum(x == "not json" for x in kept) == 1 and sum(x == nobody for x in kept) == 2 and len(kept) == 6


def test_first_lines_of_many_files(spark, tmp_path):
    """Verdicts are sent in place of lines, and the first line of an id counts wherever it stands, also a rejected one."""
    lines = tmp_path / "in"
    lines.mkdir()
    seen, want = set(), []
    for batch in range(2):
        text = []
        for k in range(240):
            line = json.dumps(profile(f"CAND_{(k * 7 + batch * 50) % 110:07d}", years=float(k)))
            text.append(line + " {}" if k % 9 == 4 else line.replace('{"candidate_id"', '{"x": NaN, "candidate_id"') if k % 31 == 3 else line)
        for n in range(6):
            (lines / f"{batch}-{n}.txt").write_text("\n".join(text[n * 40 : n * 40 + 40]) + "\n")
        # Small files are read one after the other by one task, in an order that only the reader knows.
        order = [r.value for r in spark.read.text([str(lines / f"{batch}-{n}.txt") for n in range(6)]).collect()]
        for line in order:
            name = json.loads(line.removesuffix(" {}"))["candidate_id"]
            if "NaN" in line:  # the id of such a line is not known
                want.append(line)
            elif name not in seen:
                seen.add(name)
                want += [] if line.endswith(" {}") else [line]
        stream = spark.readStream.schema("value string").text(str(lines))
        screened = screen_new_lines(stream)
        to_parquet(screened, str(tmp_path / "rows"), str(tmp_path / "state")).start().awaitTermination()
    (tmp_path / "want.jsonl").write_text("\n".join(want))
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "rows")).collect()))
    assert found == sorted(map(tuple, validate_batch(read_profiles(spark, str(tmp_path / "want.jsonl"))).collect())) and len(found) > 100
    text = screened._jdf.queryExecution().analyzed().toString()
    assert "WithState" not in text and "Union" not in text and re.search(r"Deduplicate \[_id", text)
    assert text.count("MapInArrow") == 2 and not re.search(r"MapInArrow [^\n]*\bvalue#", text)


def test_arriving_lines_take_little_disk(spark, tmp_path, monkeypatch):
    """Files arrive compressed, and orders and line items are dealt once each to make them."""
    day = dt.datetime(1997, 1, 1)
    orders = [(k, "OFP"[k % 3], 1000.0 * (k % 300), day + dt.timedelta(days=k % 900), "1-URGENT 2-HIGH 3-MEDIUM 5-LOW".split()[k % 4]) for k in range(800)]
    items = [(k, k * 31 + n, float(n * 9), n, 900.0 * n) for k in range(800) for n in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(source_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    found = sorted(map(tuple, source_queries.screen_arriving_lines(spark, str(tmp_path)).collect()))
    assert found == sorted(map(tuple, source_queries.validate_odd_lines(spark, str(tmp_path)).collect())) and len(found) == 200
    arrived = spark.read.text(str(tmp_path / "arriving/in"))
    written = sum(f.stat().st_size for f in (tmp_path / "arriving/in").glob("part-*"))
    assert arrived.count() > 320 and written < 0.25 * arrived.selectExpr("sum(length(value))").first()[0]
    assert profiles(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_sparse_vectors(spark):
    texts = [("a", "data data spark"), ("b", "spark"), ("c", ""), ("d", None), (None, "data x")]
    frame = spark.createDataFrame(texts, "candidate_id string, text string").repartition(3)
    model = TI.fit_tfidf(frame)
    words = [(k, (t or "").split()) for k, t in texts]
    df = Counter(w for _, ws in words for w in set(ws))
    idf = {w: math.log(6 / (1 + n)) + 1 for w, n in df.items()}
    assert model.n == 5 and {r.term: (r.df, round(r.idf, 12)) for r in model.terms.collect()} == {w: (df[w], round(idf[w], 12)) for w in df}
    encoded = TI.encode_tfidf(frame, model)
    got = {r.candidate_id: {x.term: x.weight for x in r.vector} for r in encoded.collect()}
    for k, ws in words:
        weight = {w: n * idf[w] for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in weight.values()))
        assert set(got[k]) == set(weight) and all(abs(got[k][w] - x / norm) < 1e-12 for w, x in weight.items())
    plan = encoded._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    asked = TI.encode_tfidf(spark.createDataFrame([("q", "spark unknown"), ("r", "unknown")], "candidate_id string, text string"), model)
    assert {r.candidate_id: [(x.term, x.weight) for x in r.vector] for r in asked.collect()} == {"q": [("spark", 1.0)], "r": []}
    assert TI.encode_tfidf(frame.where("false"), TI.fit_tfidf(frame.where("false"))).count() == 0


def test_only_three_columns_are_shuffled(spark, tmp_path):
    posting = Posting(title="X", skills=("SQL",), skill_keys=("sql",), min_years=2.0, industry="Software")
    people = [profile(f"CAND_{k % 50:07d}", years=float(k % 9)) for k in range(70)]
    df = load(spark, tmp_path, *people)
    ranked = flow.rank_profiles(df, posting, str(tmp_path / "f"), 20)
    want = flow.build_ranking(feature_table(df, posting.criteria()), 20)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, want.collect()))
    stored = spark.read.parquet(str(tmp_path / "f"))
    plan = flow.rank_stored(stored, 20)._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window [row_number()"):]
    inside = window[window.index("Window [row_number()", 5):] if "Window [row_number()" in window[5:] else window
    assert "skills" not in inside.split("Relation")[0] and "current_title" not in inside.split("Relation")[0]
    (stored.transform(add_final_score).write.parquet(str(tmp_path / "scored.parquet")))
    again = flow.load_and_rank(spark, str(tmp_path / "scored.parquet"), 20)
    assert [r.candidate_id for r in again.orderBy("rank").collect()] == [r.candidate_id for r in want.orderBy("rank").collect()]
    no_order = spark.read.parquet(str(tmp_path / "scored.parquet")).drop("ingest_ordinal").where(F.col("candidate_id") > "CAND_0000020")
    no_order.write.parquet(str(tmp_path / "plain.parquet"))
    assert flow.load_and_rank(spark, str(tmp_path / "plain.parquet"), 5).count() == 5
