"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rolecast.llm import lexical

DOCS = "doc_id long, text string, item_id int, rank string, terms int, n string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(low)


def plain(docs, items, top=10):
    """[(item, rank, doc, score)] by the formula."""
    counted = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(x for _, tf, _ in counted for x in tf)
    out = []
    for item, text in dict.fromkeys(items):
        asked, scored = Counter(words(text)), []
        for doc, tf, n in counted:
            m = 25 + 75 * n * n_docs // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x, c in asked.items() if x in tf)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k, row[3], -row[0]) for k, row in enumerate(sorted(scored, key=lambda r: r[:3])[:top], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(12)
    vocabulary = ["the", "of", "and", *[f"w{k}" for k in range(60)], "É", "ß1", "naïve"]
    weights = [40, 30, 20, *[3] * 63]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice([1, 3, 12, 40, 200]))) for _ in range(400)]
    texts += [texts[3]] * 60 + ["the of"] * 90 + [f"the of and {x}" for x in vocabulary] + [" ".join(vocabulary) * 400]
    odd = [None, "", " ", "!!! --", "THE Of\nAnd", "the\x00of", "É é", "日本 語", "a" * 5000]
    docs = [(k, t) for k, t in enumerate([*texts, *odd])]
    docs += [docs[5], docs[5], (None, texts[7]), (None, "the only w3"), (-4, "w1 w1 w2")]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.choice([1, 5, 30])))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "zzz unknown"), (103, "the the the w3"), (103, "of w4"), (0, items[0][1]), (None, "naïve É w9"), (104, "?!")]
    return docs, items


@pytest.fixture(scope="module")
def frames(spark, corpus):
    docs, items = corpus
    made = spark.createDataFrame([(*d, 1, "r", 2, "n") for d in docs], DOCS).repartition(5)
    return made, spark.createDataFrame([(*i, "r", 3) for i in items], "item_id int, text string, rank string, doc_id int")


def test_results_are_those_of_scoring_everything(frames, corpus):
    found = lexical.rank_documents(*frames)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(found) == plain(*corpus)


def test_small_trees_and_blocks_change_nothing(frames, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    assert len(list(lexical._blocks(frames[1].select("item_id", "text").distinct()))) > 5
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 200)
    assert rows_of(lexical.rank_documents(*frames, top=3)) == plain(*corpus, top=3)


def test_empty_tables(frames):
    docs, items = frames
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items), (docs, items.where("text is null"))):
        made = lexical.rank_documents(d, i)
        assert made.columns == ["item_id", "rank", "doc_id", "score"] and made.count() == 0


def tree_rows(draw, n, wide=30):
    rows = {}
    for k in range(n):
        terms = sorted(draw.sample(range(wide), draw.randint(1, 6)))
        counts = [draw.choice([1, 1, 2, 9]) for _ in terms]
        rows.setdefault((np.array(terms, ">u4").tobytes(), np.array(counts, "<i8").tobytes(), draw.choice([40, 90, 300])), []).append(k)
    return [(*key, ids) for key, ids in rows.items()]


def test_nodes_bound_what_is_below_and_branches_are_left():
    draw = random.Random(4)
    rows = tree_rows(draw, 3000)
    root = lexical.build_tree(rows)
    weights = np.array([[draw.choice([0, 0, 0, 100, 4000]) for _ in range(6)] for _ in range(30)], np.int64)
    search = lexical.Search(lexical.Asked(list("abcdef"), weights), 5)

    def check(node):
        bound = search.bound(node)
        if node.children is None:
            return [(bound, node)]
        below = [x for c in node.children for x in check(c)]
        assert all((score <= bound).all() for score, _ in below) and len(node.children) > 1
        assert node.norm == min(leaf.norm for _, leaf in below)
        return below

    leaves = check(root)
    assert sorted(i for _, leaf in leaves for i in leaf.documents) == list(range(3000))
    search.add(root)
    want = [sorted(((-int(s[k]), i) for s, leaf in leaves for i in leaf.documents if s[k] > 0))[:5] for k in range(6)]
    found = [sorted((-s, i) for item, i, s in search.rows() if item == k) for k in range(6)]
    assert found == want and search.left > 0


def test_large_weights_stay_exact():
    rows = tree_rows(random.Random(6), 50)
    weights = np.full((30, 1), 1 << 38, np.int64)
    search = lexical.Search(lexical.Asked(["x"], weights), 3)
    assert search.weights.dtype == np.int64
    search.add(lexical.build_tree(rows))
    assert lexical.build_tree([]) is None and len(list(search.rows())) == 3
