"""Dedup, search and packing operators against brute force, and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from compare import difference, duck
from rolecast.llm import bitsliced, minhash, multiindex, packing, queries, substring
from rolecast.llm.components import components
from rolecast.llm.tokens import text_encoder

SF = "/root/testdata/sf0.001"
BPE = queries.tokenizer_file(queries.BYTE_BPE)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_its_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert difference(queries.QUERIES[name](spark, sf), duck(sf), queries.ORACLES[name]) is None


def smallest_reachable(nodes, links):
    least = {x: x for x in nodes}
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return least


def test_components(spark):
    generator = random.Random(3)
    links = [(generator.randrange(300), generator.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(200)] + [(5, 5), (None, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == smallest_reachable({x for e in real for x in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- near-duplicate documents ------------------------------------------------------

def brute_near(rows, percent=85):
    hashes = minhash._WordHashes()
    sets = {k: set(minhash.shingle_set((t or "").encode(), hashes).tolist()) for k, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = smallest_reachable(sets, links)
    return {k: (len(s), least[k], least[k] == k) for k, s in sets.items()}


def edited(words, edits, generator):
    out = list(words)
    for _ in range(edits):
        out[generator.randrange(len(out))] = f"w{generator.randrange(10**6)}"
    return " ".join(out)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    # Blocks of 64 here, so that the group is cut along the orders.
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 64)
    generator = random.Random(11)
    words = [f"v{generator.randrange(10**5)}" for _ in range(120)]
    rows = [(k, edited(words, generator.randrange(0, 3), generator)) for k in range(400)] + [(400 + k, " ".join(words)) for k in range(50)]
    rows += [(1000 + k, edited([f"u{generator.randrange(10**6)}" for _ in range(40)], 0, generator)) for k in range(200)]
    found = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_near(rows)
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert found == want


def test_no_pair_of_a_large_loose_group_is_left_out(spark, monkeypatch):
    # Documents of one template with agreement high enough for one group, and few true pairs among them.
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 24)
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "PASSES", 1)
    generator = random.Random(17)
    template = [f"t{k}" for k in range(170)]
    rows = []
    for k in range(300):
        own = [f"o{k}x{j}" for j in range(34)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:26] + [f"p{k}x{j}" for j in range(8)]))]
    generator.shuffle(rows)
    found = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute_near(rows)


def test_agreement_follows_the_percent():
    assert np.ceil(128 * minhash.least_agreement(85)) == 93 and minhash.least_agreement(80) == pytest.approx(0.6586, abs=1e-4)
    # A pair of similarity 0.81 whose signatures agree on 0.68 of the values is compared.
    sets = [np.arange(1, 201, dtype=np.uint64), np.concatenate([np.arange(1, 181), np.arange(901, 923)]).astype(np.uint64)]
    sig = np.arange(128, dtype=">u2")
    other = np.where(np.arange(128) < 87, sig, sig + 1000).astype(">u2")
    batch = minhash.pa.RecordBatch.from_pylist([{"block": 1, "rep": k, "sig": g.tobytes(), "body": x.astype("<u8").tobytes(), "sub": None} for k, (g, x) in enumerate(zip((sig, other), sets))])
    assert [b.num_rows for b in minhash._confirm(iter([batch]), 80)] == [1]


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"x{k % 7000}" for k in range(60_000))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "a b c d e"), (6, "A B C D E"), (7, long), (8, long + " end"), (9, "é É"), (10, "É É"), (None, "a b c d e"), (5, "a b c d e")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, rep int, sig int, component int")
    found = minhash.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = brute_near([r for r in rows[:11]])
    assert got == sorted([(k, *want[k]) for k in [*range(11), 5]] + [(None, 1, None, True)], key=repr)
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, percent=70)


# -- substrings --------------------------------------------------------------------------

def test_cuts_resist_insertions():
    generator = random.Random(2)
    text = " ".join("".join(generator.choice("abcdefgh") for _ in range(generator.randrange(2, 9))) for _ in range(2000)).encode()
    moved = text[:3000] + b"some inserted words " + text[3000:]
    a, b = ({t[x:y] for x, y in zip([0, *e.tolist()], e.tolist())} for t, e in ((text, substring.chunk_ends(text)), (moved, substring.chunk_ends(moved))))
    assert len(a - b) <= 4 and b"".join(text[x:y] for x, y in zip([0, *substring.chunk_ends(text).tolist()], substring.chunk_ends(text).tolist())) == text
    sizes = np.diff(substring.chunk_ends(text))
    assert 25 < sizes.mean() < 50 and sizes.max() < 300


def brute_cuts(rows):
    """The kept texts, by the rule itself over the chunk function."""
    order = sorted({k: t for k, t in rows if k is not None}.items())
    first = {}
    for k, t in order:
        raw, ends = (t or "").encode(), substring.chunk_ends((t or "").encode()).tolist()
        for x, y in zip([0, *ends], ends):
            first.setdefault(raw[x:y], (k, x))
    out = {}
    for k, t in order:
        raw, ends = (t or "").encode(), substring.chunk_ends((t or "").encode()).tolist()
        runs, spans = [], list(zip([0, *ends], ends))
        for x, y in spans:
            if first[raw[x:y]] != (k, x):
                if runs and runs[-1][1] == x:
                    runs[-1][1] = y
                else:
                    runs.append([x, y])
        kept, at = b"", 0
        for x, y in runs:
            if y - x >= substring.MIN_BYTES:
                kept, at = kept + raw[at:x], y
        out[k] = None if t is None else (kept + raw[at:]).decode()
    return out


def prose(generator, n):
    return " ".join("".join(generator.choice("abcdefghijklmnoprstué") for _ in range(generator.randrange(2, 10))) for _ in range(n))


def test_repeated_passages_go(spark):
    generator = random.Random(8)
    passages = [prose(generator, 55) for _ in range(40)]
    rows = [(k, f"{prose(generator, 60)} {passages[k % 40]} {prose(generator, 30)}") for k in range(120)]
    rows += [(200, None), (201, ""), (202, "x" * 5000), (203, "Short."), (204, rows[0][1]), (205, f"{passages[0]} {passages[0]}"), (None, rows[0][1]), (203, "Short.")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, doc int, cut_spans int")
    found = substring.dedup_substrings(docs)
    assert found.columns == ["doc_id", "text", "doc", "cut_spans"] and found.count() == len(rows)
    got = {r.doc_id: r for r in found.collect()}
    assert {k: r.text for k, r in got.items() if k is not None} == brute_cuts(rows) and got[None].text == rows[0][1]
    for k in range(40, 120):  # caught: the passage is not whole any more, what is around it is
        assert passages[k % 40] not in got[k].text and len(got[k].cut_spans) == 1
        assert rows[k][1][:250] == got[k].text[:250]
    assert all(not got[k].cut_spans for k in range(40))
    assert substring.dedup_substrings(docs.where("false")).count() == 0


def test_texts_of_one_key_are_cut_each_by_its_own_spans(spark):
    generator = random.Random(9)
    passage, own = prose(generator, 80), prose(generator, 80)
    rows = [(1, passage), (2, f"{prose(generator, 20)} {passage}"), (2, own), (2, own)]
    found = substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(r.text for r in found if r.doc_id == 2)
    assert got.count(own) == 2 and len(got) == 3 and passage not in "".join(got) and [r.text for r in found if r.doc_id == 1] == [passage]


def test_substring_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: r.text for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert found == brute_cuts(rows)


# -- vectors --------------------------------------------------------------------------------

def test_bitmap_sums_and_order():
    generator = np.random.default_rng(4)
    for dims, n, low, high in ((3, 70, -4, 5), (64, 500, -256, 256), (7, 130, 0, 2), (1, 5, -3, 3)):
        rows, query = generator.integers(low, high, (n, dims)), generator.integers(low, high, dims)
        rows[n // 2 :] = rows[: n - n // 2][::-1]  # ties
        index = bitsliced.BitSlicedIndex(np.arange(n), rows)
        for k in (1, 5, n + 3):
            ids, scores = index.top(query, 2, k)
            exact = rows @ query
            want = sorted((-s, i) for i, s in enumerate(exact.tolist()) if i != 2)[:k]
            assert list(zip((-scores).tolist(), ids.tolist())) == want


def test_topk_over_blocks_and_odd_vectors(spark):
    generator = np.random.default_rng(6)
    rows = [(k, generator.normal(0, 0.2, 8).tolist(), 1, 1) for k in range(400)] + [(400 + k, [0.5] * 8, 1, 1) for k in range(30)]
    bad = [(900, None, 1, 1), (950, [float("nan")] * 8, 1, 1), (1000, [None] * 8, 1, 1), (1050, [float("inf")] + [0.0] * 7, 1, 1), (1100, [1.0], 1, 1), (None, [0.1] * 8, 1, 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int, rank int")
    quantised = table.select("*", bitsliced.quantised(table.embedding).alias("vector"))
    got = bitsliced.top_by_inner_product(quantised, quantised.where("vec_id % 50 = 0"), 5, row_block=100, query_block=3).collect()
    whole = {k: np.floor(256 * np.array(v)).astype(int) for k, v, *_ in rows}
    want = []
    for q in range(0, 430, 50):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q)[:5]
        want += [(q, nr, k, -s) for nr, (s, k) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == want
    assert bitsliced.top_by_inner_product(quantised.where("false"), quantised.where("false"), 5).count() == 0


def test_near_vectors_with_hot_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "CELL_ROWS", 32)
    monkeypatch.setattr(multiindex, "VISIT_ROWS", 64)
    generator = np.random.default_rng(9)
    centres = generator.normal(0, 1, (12, 16))
    rows = [(k, (centres[k % 12] + generator.normal(0, [0.05, 0.2, 0.35][k % 3], 16)).tolist()) for k in range(600)] + [(600 + k, centres[0].tolist()) for k in range(200)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [1.0]), (None, centres[0].tolist())]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows + bad], "vec_id long, embedding array<double>, rep int, n int")
    got = {r.vec_id: tuple(r)[1:] for r in multiindex.near_vectors(table).collect()}
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    least = smallest_reachable(range(len(rows)), list(zip(*np.nonzero(near))))
    want = {k: (int(near[k].sum()), least[k], least[k] == k) for k in range(len(rows))}
    want |= {k: (0, k, True) for k in range(900, 905)} | {None: (0, None, True)}
    assert got == want
    assert multiindex.near_vectors(table.where("false")).count() == 0
    # A target below 1 stops the traversal earlier and still finds its share.
    some = sum(r.n_links for r in multiindex.near_vectors(table, target_recall=0.9).collect())
    assert 0.9 * near.sum() <= some <= near.sum()


def test_a_hot_group_hides_no_links_of_others(spark):
    generator = np.random.default_rng(12)

    def near(centre, cosine):
        step = generator.normal(0, 1, centre.shape)
        step -= (step * centre).sum(-1, keepdims=True) * centre
        return cosine * centre + np.sqrt(1 - cosine**2) * step / np.linalg.norm(step, axis=-1, keepdims=True)

    unit = lambda n: (x := generator.normal(0, 1, (n, 64))) / np.linalg.norm(x, axis=1, keepdims=True)
    one = unit(1000)
    vectors = np.concatenate([near(np.repeat(unit(1), 1000, 0), 0.9999), one, near(one, 0.955)])
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    linked = vectors @ vectors.T >= 0.95
    want = dict(enumerate((linked.sum(1) - 1).tolist()))
    assert {r.vec_id: r.n_links for r in multiindex.near_vectors(table).collect()} == want
    # The calibrated bound is not set by the group alone either.
    sample = np.concatenate([vectors[:1000:4], vectors[1000:]])
    index = multiindex.fit_index(sample, 0.95, 0.999)
    found = [set(c) for _, c in index.visits(sample[250:1250])]
    (first, _), (second, _) = index.distances(sample[1250:])
    assert np.mean([a * len(index.books[1]) + b in c for a, b, c in zip(first.tolist(), second.tolist(), found)]) >= 0.99


def test_traversal_takes_cells_by_rising_distance():
    draw = np.random.default_rng(2)
    for _ in range(50):
        first, second, limit = np.sort(draw.integers(0, 9, 6)) / 8, np.sort(draw.integers(0, 9, 4)) / 8, draw.integers(0, 17) / 8
        i, j = multiindex.multi_sequence(first, second, limit)
        sums = [first[a] + second[b] for a, b in zip(i, j)]
        assert sums == sorted(sums) and set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(6) for b in range(4) if first[a] + second[b] <= limit}


def test_grid_grows_and_rows_outside_the_sample_are_found():
    draw = np.random.default_rng(7)
    assert [multiindex.codes_for(n) for n in (0, 500, 50_000, 10**9)] == [4, 4, 32, 512]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    middle = unit(draw.normal(size=(40, 32)))
    rows = unit(middle[draw.integers(40, size=6000)] + draw.normal(size=(6000, 32)) * 0.08)
    rows[:3000:2] = multiindex.neighbours_at(rows[1:3000:2], 0.951, draw)
    index = multiindex.fit_index(rows[4000:5000], 0.95, 0.9995, 10)  # no planted pair is in the sample
    (one, _), (two, _) = index.distances(rows)
    cell = one * len(index.books[1]) + two
    seen = [set(c.tolist()) for _, c in index.visits(rows)]
    a, b = np.nonzero(rows @ rows.T >= 0.95)
    assert np.mean([cell[y] in seen[x] for x, y in zip(a, b)]) >= 0.99
    planted = [cell[k + 1] in seen[k] and cell[k] in seen[k + 1] for k in range(0, 3000, 2)]
    assert np.mean(planted) >= 0.99 and np.mean([len(s) for s in seen]) < 0.5 * len(index.books[0]) * len(index.books[1])
    assert (multiindex.fit_index(rows[:500], 0.95, 1.0, 8).bounds == 2 - 2 * 0.95).all()


def test_vectors_of_other_lengths_take_nothing_away(spark):
    draw = np.random.default_rng(3)
    eight = [(k, draw.normal(size=8).tolist()) for k in range(120)]
    eight += [(200 + k, (np.array(eight[k][1]) * 2).tolist()) for k in range(60)]
    nine = [(900, [1.0] * 9)]
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = lambda rows: {r.vec_id: r.n_links for r in multiindex.near_vectors(make(rows)).collect()}
    alone = links(eight)
    assert sum(alone.values()) >= 120 and links(eight + nine) == {**alone, 900: 0}
    both = links(eight + nine + [(901, [1.0] * 9), (902, [2.0] * 9)])
    assert {k: both[k] for k in alone} == alone and [both[k] for k in (900, 901, 902)] == [2, 2, 2]
    table = lambda rows: make(rows).select("vec_id", bitsliced.quantised(F.col("embedding")).alias("vector"))
    top = lambda rows: sorted(map(tuple, bitsliced.top_by_inner_product(table(rows), table(rows).where("vec_id % 50 = 0"), 5).collect()))
    assert len(top(eight)) == 25 and [r for r in top(eight + nine) if r[0] != 900] == top(eight)
    assert [r for r in top(eight + nine + [(901, [1.0] * 9)]) if r[0] == 900] == [(900, 1, 901, 9 * 256 * 256)]


def test_components_too_large_for_exact_scores_are_an_error(spark):
    make = lambda x: spark.createDataFrame([(0, [x, 1.0]), (1, [x, 2.0])], "vec_id long, embedding array<double>").select("vec_id", bitsliced.quantised(F.col("embedding")).alias("vector"))
    for x in (1e300, 1e12):
        with pytest.raises(Exception, match="too large|64 bits"):
            bitsliced.top_by_inner_product(make(x), make(x), 5).collect()
    assert bitsliced.top_by_inner_product(make(1e4), make(1e4), 5).count() == 2


def test_the_registered_query_asks_for_every_link(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(multiindex, "near_vectors", lambda rows, threshold, target_recall=1.0: asked.append((threshold, target_recall)))
    queries.QUERIES["op8_embedding_dedup"](spark, SF)
    assert asked == [(0.95, 1.0)]


# -- packing --------------------------------------------------------------------------------

def least_bins(items, capacity):
    """The fewest bins, by trying everything."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + items[k] <= capacity:
                at = bins.index(b)
                place(k + 1, [*bins[:at], b + items[k], *bins[at + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best[0]


def bins_of(runs, capacity):
    filled = {}
    for run in runs:
        for k in range(run.bins):
            assert filled.get(run.sequence + k, 0) == run.place
            filled[run.sequence + k] = run.place + run.each * run.length
    assert all(x <= capacity for x in filled.values())
    return filled


def test_dominating_sets_keep_the_optimum():
    generator = random.Random(7)
    used = 0
    for _ in range(300):
        capacity = generator.randrange(8, 30)
        items = [generator.randrange(1, capacity + 1) for _ in range(generator.randrange(1, 9))]
        counts = np.bincount(items, minlength=capacity + 1)
        chosen = packing.dominating_set(counts, max(items), capacity)
        if chosen is None:
            continue
        used += 1
        rest = list(items)
        for x in chosen:
            rest.remove(x)
        assert sum(chosen) <= capacity and 1 + least_bins(rest, capacity) == least_bins(items, capacity), (items, capacity, chosen)
    assert used > 150


def test_runs_place_everything_near_the_bound():
    for seed in range(60):
        generator = np.random.default_rng(seed)
        lengths = np.clip(generator.lognormal(5.5, 1, 3000).astype(int), 1, 1024)
        histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
        filled = bins_of(packing.plan_runs(histogram), 1024)
        assert sum(filled.values()) == lengths.sum() and len(filled) <= -(-lengths.sum() // 1024) * 1.02 + 2
    assert packing.plan_runs({}) == []
    with pytest.raises(ValueError):
        packing.plan_runs({1025: 1})


def test_packed_documents(spark):
    texts = [None, "", "a"] + ["word " * n for n in (10, 500, 1022, 1023, 1024, 5000)] + ["same text here"] * 3000
    docs = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, "no key", 1, 2), (2, "a", 1, 2)], "doc_id long, text string, piece int, length int")
    cut = packing.cut_documents(docs, BPE, 2).cache()
    found = packing.pack_pieces(cut).collect()
    encode, by_doc, by_sequence = text_encoder(BPE), {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {*range(len(texts)), None} and len(by_doc[2]) == 2
    for k, t in enumerate(texts):
        if k != 2:
            rows = sorted(by_doc[k], key=lambda r: r.piece)
            assert b"".join(bytes(r.ids) for r in rows) == encode(t or "") + b"\2\0\0\0"
            assert [r.piece for r in rows] == list(range(len(rows))) and all(r.length == 1024 for r in rows[1:])
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(by_sequence) <= -(-total // 1024) + 2
    assert packing.pack_pieces(packing.cut_documents(docs.where("false"), BPE, 2)).count() == 0


# -- pipeline ----------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept["language_id"].count() == sum(any(c.isalpha() for c in t or "") for t in texts.values())
    read = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    first = read("language_id")
    near = brute_near(sorted(first.items()))
    assert read("near_dedup") == {k: t for k, t in first.items() if near[k][2]}
    assert read("substring_dedup") == brute_cuts(sorted(read("near_dedup").items()))
    masked = read("secret_scan")
    assert all(("[SECRET]" in masked[k]) == (masked[k] != t) for k, t in read("substring_dedup").items())
    encode = text_encoder(BPE)
    pieces = kept["best_fit_packing"].collect()
    assert sum(r.length for r in pieces) == sum(len(encode(t)) // 4 + 1 for t in masked.values())
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r)[:5] for r in pieces}


def test_pipeline_stages_take_odd_rows(spark):
    rows = [(1, None, None, "s", None), (1, None, None, "s", None), (2, "", "en", None, 0), (3, "12 34", "en", "s", 5), (None, "words without a key", "en", "s", 19), (4, "plain words here", "en", "s", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", docs_flag())
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, SF).columns == frame.columns
            assert stage(spark, frame, SF).count() <= frame.count()
        corpus_pipeline.STAGES[-1][1](spark, frame, SF).count()


def test_pipeline_stages_do_what_they_say_on_odd_rows(spark):
    passage = " ".join(f"word{k}{'abcdefg'[k % 7]}" for k in range(80))
    rows = [(1, None, None, "s", None), (1, None, None, "s", None), (2, "", "en", None, 0), (3, "12 34", "en", "s", 5), (None, "words without a key", "en", "s", 19),
            (4, "plain words here token=abcdefgh12", "en", "s", 33), (4, "plain words here token=abcdefgh12", "en", "s", 33), (6, passage, "en", "s", 1), (7, passage, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = lambda name: [tuple(r) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, SF).collect()]
    texts = lambda found: sorted(((str(r[0]), str(r[1])) for r in found))
    assert texts(run("language_id")) == texts([r for r in rows if r[1] and r[1] != "12 34"])
    assert texts(run("near_dedup")) == texts([r for r in rows if r[0] != 7])
    cut = {r[0]: r for r in run("substring_dedup") if r[0] != 4}
    assert cut[6][1] == passage and len(cut[7][1]) < len(passage) / 2 and cut[7][4] == len(cut[7][1]) and cut[1][1] is None and cut[2][1] == ""
    assert len(run("substring_dedup")) == len(run("secret_scan")) == len(run("best_fit_packing")) == len(rows)
    masked = [r for r in run("secret_scan") if r[0] == 4]
    assert [r[1] for r in masked] == ["plain words here [SECRET]"] * 2 and all(r[4] == 25 for r in masked)
    packed = {r["doc_id"]: r for r in dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, SF).collect()}
    assert packed[1]["length"] == packed[2]["length"] == 1 and packed[3]["length"] > 1


def docs_flag():
    from pyspark.sql import functions as F

    return F.lit(1)
