"""Joins by contained texts against looking everywhere."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from rolecast.functions.text import normalise_skill
from rolecast.operators import containment
from rolecast.operators import retrieve as R
from rolecast.operators import skill as L
from rolecast.operators.containment import containing
from samples import load, profile, skill


def test_contained_texts(spark):
    draw = random.Random(1)
    texts = [(k, "".join(draw.choices("aabé日 x", k=draw.randint(0, 30)))) for k in range(300)] + [(300, None), (301, "aaaa"), (302, "")]
    needles = ["", "a", "é", "ab", "aab", "日 x", "aaaa", "zz", "xa日a", None, "a", "b" * 40] + [t[3:9] for _, t in texts[:40] if t]
    frame = spark.createDataFrame(texts, "id long, text string").repartition(4)
    found = containing(frame, spark.createDataFrame([(x,) for x in needles], "needle string"))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted({(k, n) for k, t in texts for n in needles if t is not None and n is not None and n in t}) and len(got) == len(set(got))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert containing(frame.where("false"), spark.createDataFrame([("a",)], "needle string")).count() == 0
    assert containing(frame, spark.createDataFrame([], "needle string")).count() == 0


def test_contained_texts_within_a_task(monkeypatch):
    """Windows and texts end anywhere, also inside a needle."""
    draw = random.Random(5)
    for window in (5, 64, 1 << 18):
        monkeypatch.setattr(containment, "_WINDOW", window)
        for _ in range(40):
            texts = ["".join(draw.choices("aabé日 x\0", k=draw.randint(0, 40))) if draw.random() < 0.9 else None for _ in range(draw.randint(0, 30))]
            needles = list({"".join(draw.choices("aabé日 x\0", k=draw.randint(1, 8))) for _ in range(30)} | {t[2:19] for t in texts if t and len(t) > 2})
            finder = containment.Finder([n.encode() for n in needles])
            for at in (0, len(texts) // 2):
                got = finder.found(pa.array(texts, pa.string()).slice(at))
                assert got.tolist() == [[t is not None and n in t for t in texts[at:]] for n in needles]
    assert containment.Finder([]).found(pa.array(["a"])).shape == (0, 1)


def test_blocks_of_postings(spark, monkeypatch):
    """Whatever comes at once, the rows are those of a search in all texts; names may be missing or come twice."""
    draw = random.Random(6)
    words = ["ab", "b", "abc", "the data", "日本", "zz", "data lake"]
    rows = [(None if k % 19 == 3 else f"N{draw.randint(0, 150):03d}", " ".join(draw.choices(words, k=draw.randint(0, 4))) if k % 23 else None) for k in range(400)]
    asked = [(None if p == 4 else p, draw.choices([*words, "Data", "a"], k=draw.randint(1, 5))) for p in range(25)] + [(7, ["ab"]), (30, []), (31, ["", None])]
    given = {}
    for p, ws in asked:
        given.setdefault(p, []).extend(w.lower() for w in ws if w)
    want = []
    for p, ws in given.items():
        hits = [(-sum(w in t for w in ws), c is None, c or "") for c, t in rows if t]
        want += [(p, None if none else c, -h, k) for k, (h, none, c) in enumerate(sorted(h for h in hits if h[0] <= -2)[:6], 1)]
    frame = spark.createDataFrame(rows, "candidate_id string, t string").repartition(4)
    frame = frame.select("candidate_id", "t")
    postings = spark.createDataFrame(asked, "posting_id int, keywords array<string>")
    for kept in (1 << 20, 40):
        monkeypatch.setattr(R, "_KEPT", kept)
        found = R.keyword_topn_by_posting(frame, postings, 6, 2, text=F.col("t"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    none = R.keyword_topn_by_posting(frame, postings.where("false"), 6, 2, text=F.col("t"))
    assert none.count() == 0 and none.columns == ["posting_id", "candidate_id", "hits", "position"]
    assert R.keyword_topn_by_posting(frame, postings, 0, 2, text=F.col("t")).count() == 0


def test_best_rows_of_a_task():
    """Kept rows are cut again and again, in small and in large batches."""
    draw = random.Random(7)
    asked = [[(b"a", 1), (b"bc", 2), (b"abcd", 1)], [(b"d", 1)], [(b"zzzz", 3)], [(b"c", 1), (b"dd", 1)]]
    rows = [(draw.choice([None, *"pqrstu"]), "".join(draw.choices("abcd", k=draw.randint(0, 9)))) for _ in range(3000)]
    for step in (7, 1000):
        best = R.TopHits(asked, 5, 1)
        for at in range(0, len(rows), step):
            names, texts = zip(*rows[at : at + step])
            best.add(pa.array(names, pa.string()), pa.array(texts, pa.string()))
            best.waiting += 1 << 16  # cut each time
        found = best.table(3).to_pylist()
        for p, ws in enumerate(asked):
            hits = sorted((-sum(n for w, n in ws if w.decode() in t), c is None, c or "") for c, t in rows)
            assert [(r["hits"], r["_name"]) for r in found if r["_at"] == p] == [(-h, None if none else c) for h, none, c in hits[:5] if h]


def test_pairs_of_postings_and_texts_stay_in_a_task(spark):
    """Neither pieces of texts nor pairs of texts and keywords are written or sent."""
    frame = spark.createDataFrame([("a", "spark sql")], "candidate_id string, t string")
    found = R.keyword_topn_by_posting(frame, spark.createDataFrame([(1, ["spark", "ql"])], "posting_id int, keywords array<string>"), 5, 1, text=F.col("t"))
    assert [tuple(r) for r in found.collect()] == [(1, "a", 2, 1)]
    text = found._jdf.queryExecution().optimizedPlan().toString()
    sent = text[text.index("MapInArrow") :]
    assert "Generate" not in text and "Aggregate" not in text and "Join" not in sent and "Relation" not in text


def test_keywords_of_many_postings(spark):
    draw = random.Random(2)
    words = ["spark", "sql", "kafka", "go", "c", "data lake", "Éa"]
    rows = [(f"CAND_{k % 90:04d}" if k % 17 else None, k, " ".join(draw.choices(words, k=draw.randint(0, 5))).lower()) for k in range(200)]
    asked = [(p, [w if draw.random() < 0.7 else w.upper() for w in draw.choices([*words, "ar", "zzz", "", None], k=draw.randint(0, 6)) if w is not None] + [None]) for p in range(30)]
    frame = spark.createDataFrame(rows, "candidate_id string, ingest_ordinal long, t string").repartition(5)
    found = R.keyword_topn_by_posting(frame, spark.createDataFrame(asked, "posting_id int, keywords array<string>"), 12, 1, text=F.col("t"))
    got = {}
    for r in found.orderBy("position").collect():
        got.setdefault(r.posting_id, []).append((r.candidate_id, r.hits))
    for p, words_of in asked:
        hits = [(-sum(w.lower() in t for w in words_of if w), c is None, c or "", k, c) for c, k, t in rows]
        want = [(h[4], -h[0]) for h in sorted(h for h in hits if h[0])[:12]]
        assert got.get(p, []) == want


def test_skills_of_all_profiles_for_all_postings(spark, tmp_path):
    names = ["Python", "Py", "Machine Learning", "learning", "C++", "日本語", "", None, "SQL", "MySQL"]
    draw = random.Random(3)
    people = [profile(f"CAND_{k:07d}", skills=[skill(draw.choice(names)) for _ in range(draw.randint(0, 6))]) for k in range(25)]
    df = load(spark, tmp_path, *people).drop("ingest_ordinal").withColumn("ingest_ordinal", F.monotonically_increasing_id())
    postings = [("a", ["python", "sql"]), ("b", ["machine learning engineer", "c"]), ("c", []), ("d", [""]), ("e", ["mysql", "sql", "cobol"])]
    asked = spark.createDataFrame(postings, "posting_id string, skill_keys array<string>")
    for mode in ("substring", "exact"):
        rows = L.matched_skill_rows(df, asked, mode)
        got = sorted((r.ingest_ordinal, r.posting_id, r["name"]) for r in rows.collect())
        want = []
        for p, keys in postings:
            array = F.array(*[F.lit(k) for k in keys]) if keys else F.array().cast("array<string>")
            want += [(r[0], p, r[1]) for r in df.select("ingest_ordinal", F.explode(L.matched_skills(F.col("skills"), array, mode)).alias("s")).select("ingest_ordinal", "s.name").collect()]
        assert got == sorted(want)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.select(normalise_skill(F.lit("日本語")).alias("x")).first().x == ""
