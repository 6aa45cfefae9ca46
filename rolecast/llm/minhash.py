"""Near-duplicate documents: MinHash signatures in an LSH forest, confirmed on full sets.

1. Each document becomes its set of hashed five-word shingles, a digest of that set and a
   signature of 128 MinHash values. Equal sets are one class from here on.
2. The forest: 16 sorted orders of the classes, each by its own eight signature
   values. Classes that share the first four values with no other class in any order are
   done. The rest are laid out by order and key; in each order a class meets its
   neighbours with the longest common prefix, so that a dense region is read at greater depth
   than a thin one. Pairs whose signatures agree on enough of the values
   (four standard errors below the wanted similarity: 0.72 at 0.85, 0.66 at 0.80) are candidates.
3. Candidates form loose groups. A group of bounded size is one block. A larger one is cut
   along four of the orders: each region is taken at the least depth (2, 4, 8 values) that
   makes it fit, and what is too large even there is dealt out; the 16 classes with most
   candidates of the group (hubs) join every block of it.
4. In a block, the pairs with sufficient agreement are compared by their full
   sets, best first, skipping pairs that are connected already. Confirmed links are
   contracted into components.
5. This leaves links out in the larger groups. There, the classes that share the first four values in
   any of the 16 orders form regions (or the whole group is one, if that is less work). A
   region is cut into parts that meet pairwise in blocks; only parts of the largest component do
   not meet each other. Pairs connected by step 4 are skipped, all others compared as there.

No group is gathered in one task and no row is dropped. The full sets cross the network only
for classes with candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecast.llm.common import Unions, slices, written
from rolecast.llm.components import components

WORDS = 5
VALUES = 128
ORDERS = 16
KEY_VALUES = 8
FIRST_VALUES = 4
NEIGHBOURS = 16
ERRORS = 4
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000
PASSES = 4
DEPTHS = (2, 4, 8)
HUBS = 16
_WORD_CACHE = 500_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def least_agreement(percent: int) -> float:
    """The share of equal signature values from which a pair is a candidate."""
    s = percent / 100
    return s - ERRORS * (s * (1 - s) / VALUES) ** 0.5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
_FACTOR = _mixed(np.arange(100, 100 + VALUES, dtype=np.uint64)) | np.uint64(1)
_OFFSET = _mixed(np.arange(900, 900 + VALUES, dtype=np.uint64))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= _WORD_CACHE:
                self.clear()
            self[word] = found
        return found


def shingle_set(text: bytes, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of UTF-8 text.

    A-Z is lower-cased; words are what ASCII white space separates. With fewer words the
    whole sequence is the only shingle; without words the set is empty.
    """
    found = text.translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if len(found) < words:
        return _mixed((values * _PLACE[: len(found)]).sum(keepdims=True) + np.uint64(len(found)))
    size = len(values) - words + 1
    total = np.zeros(size, np.uint64)
    for k in range(words):
        total += values[k : k + size] * _PLACE[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """128 MinHash values, 16 bits of each."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = (shingles[None, at : at + 2048] ^ _OFFSET[:, None]) * _FACTOR[:, None]
        np.minimum(least, part.min(1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(batch: pa.RecordBatch, column: int, hashes: dict) -> Iterator[tuple[int, np.ndarray]]:
    texts = batch.column(column)
    for first, count in slices(texts):
        for k, text in enumerate(texts.slice(first, count).cast(pa.binary()).to_pylist(), first):
            yield k, shingle_set(text or b"", hashes)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, set_key, sig)``; set_key and sig are NULL for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n, keys, sigs = [], [], []
            for _, found in _sets(batch, 1, hashes):
                n.append(len(found))
                keys.append(_digest(found) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _rows(batch: pa.RecordBatch, column: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, -1)


def _neighbours(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by order and key: each with the root of its local group and its number of candidates."""
    carry: tuple[np.ndarray, ...] | None = None
    groups, degree = Unions(), {}
    for batch in batches:
        if not batch.num_rows:
            continue
        now = (batch.column(0).to_numpy(), _rows(batch, 1, ">u2"), _rows(batch, 3, ">u2"), batch.column(2).to_numpy())
        old = 0 if carry is None else len(carry[0])
        if carry is not None:
            now = tuple(np.concatenate(x) for x in zip(carry, now))
        order, key, sig, rep = now
        for step in range(1, NEIGHBOURS + 1):
            if step >= len(rep):
                break
            first = np.arange(max(0, old - step), len(rep) - step)
            near = (order[first] == order[first + step]) & (key[first, :FIRST_VALUES] == key[first + step, :FIRST_VALUES]).all(1)
            first = first[near]
            first = first[(sig[first] == sig[first + step]).mean(1) >= least]
            for a, b in zip(rep[first].tolist(), rep[first + step].tolist()):
                if a != b:
                    groups.join(a, b)
                    degree[a] = degree.get(a, 0) + 1
                    degree[b] = degree.get(b, 0) + 1
        carry = tuple(x[-NEIGHBOURS:] for x in now)
    if degree:
        reps = list(degree)
        yield pa.RecordBatch.from_arrays(
            [pa.array(reps, pa.int64()), pa.array([groups.root(x) for x in reps], pa.int64()), pa.array([degree[x] for x in reps], pa.int64())], names=["rep", "root", "degree"]
        )


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: links confirmed on full sets, one for each connection made.

    Rows with equal ``sub`` are connected already; NULL says nothing.
    """

    least = least_agreement(percent)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        unique = {r[0]: r for r in rows}
        reps = sorted(unique)
        sets = [np.frombuffer(unique[r][2], "<u8") for r in reps]
        sigs = np.stack([np.frombuffer(unique[r][1], ">u2") for r in reps])
        sizes = np.array([len(s) for s in sets])
        found: list[tuple[float, int, int]] = []
        for a in range(len(reps) - 1):
            agree = (sigs[a + 1 :] == sigs[a]).mean(1)
            other = sizes[a + 1 :]
            ok = (agree >= least) & (100 * np.minimum(other, sizes[a]) >= percent * np.maximum(other, sizes[a]))
            found += [(-agree[k], a, a + 1 + int(k)) for k in np.flatnonzero(ok)]
        groups, out = Unions(), []
        known: dict[int, int] = {}
        for at, rep in enumerate(reps):
            if (sub := unique[rep][3]) is not None:
                groups.join(at, known.setdefault(sub, at))
        for _, a, b in sorted(found):
            if groups.root(a) == groups.root(b):
                continue
            small, large = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int((large[at] == small).sum())
            if 100 * both >= percent * (len(small) + len(large) - both):
                groups.join(a, b)
                out.append((reps[a], reps[b]))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    held: list[tuple] = []
    current = None
    for batch in batches:
        for block, rep, sig, body, sub in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if block != current and held:
                yield links(held)
                held.clear()
            current = block
            held.append((rep, sig, body, sub))
    if held:
        yield links(held)


def _agreeing(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, rep, sub, sig, n_shingles)`` sorted by block: those whose signature and size allow a link to a row with another ``sub``.

    One row at most for each row that came in; pairs are not given out.
    """
    least = least_agreement(percent)

    def meet(block: int, rows: list[tuple]) -> pa.RecordBatch:
        rep, sub, sig, size = zip(*rows)
        sigs, subs, sizes = np.stack([np.frombuffer(x, ">u2") for x in sig]), np.array(sub, np.int64), np.array(size, np.int64)
        good = np.zeros(len(rows), bool)
        for a in range(len(rows) - 1):
            other = slice(a + 1, None)
            ok = (subs[other] != subs[a]) & (100 * np.minimum(sizes[other], sizes[a]) >= percent * np.maximum(sizes[other], sizes[a]))
            ok &= (sigs[other] == sigs[a]).mean(1) >= least
            good[a] |= ok.any()
            good[other] |= ok
        at = np.flatnonzero(good)
        return pa.RecordBatch.from_arrays([pa.array([rep[k] for k in at], pa.int64()), pa.array(subs[at]), pa.array([block] * len(at), pa.int64())], names=["rep", "sub", "block"])

    held: list[tuple] = []
    current = None
    for batch in batches:
        for block, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if block != current and held:
                yield meet(current, held)
                held.clear()
            current = block
            held.append(tuple(row))
    if held:
        yield meet(current, held)


def _orders(classes: DataFrame) -> DataFrame:
    """One row per class and order, with the order's key of eight values."""
    wide = 2 * KEY_VALUES
    return classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).withColumn("key", F.expr(f"substring(sig, tree * {wide} + 1, {wide})"))


def _blocks(groups: DataFrame) -> DataFrame:
    """``(rep, block)`` for classes with ``(rep, comp, degree, n_shingles, sig)``."""
    weight = F.lit(1.0) / BLOCK_ROWS + F.col("n_shingles") / BLOCK_SHINGLES
    groups = groups.withColumn("weight", weight)
    total = groups.groupBy("comp").agg(F.sum("weight").alias("all"))
    small = groups.join(total.where("all <= 2"), "comp").select("rep", F.xxhash64("comp").alias("block"))
    large = written(groups.join(total.where("all > 2"), "comp"), "large-groups")
    if large.isEmpty():
        return small
    wide = 2 * KEY_VALUES
    # Regions of four orders at three depths; a class takes the least depth that fits.
    at = large.select("comp", "rep", "weight", "sig", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("tree"))
    key = lambda depth: F.xxhash64("comp", "tree", F.lit(depth), F.expr(f"substring(sig, tree * {wide} + 1, {2 * depth})"))
    deep = at.select("comp", "rep", "weight", "tree", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), key(d).alias("region")) for d in DEPTHS])).alias("at")).select("comp", "rep", "weight", "tree", "at.*")
    regions = deep.groupBy("region").agg(F.sum("weight").alias("held"))
    sized = deep.join(regions, "region")
    fits = sized.groupBy("comp", "rep", "tree").agg(
        F.min_by("region", F.when(F.col("held") <= 1, F.col("depth"))).alias("fit"), F.max_by("region", "depth").alias("last"), F.max_by("held", "depth").alias("held"))
    placed = fits.select("comp", "rep", F.coalesce("fit", F.xxhash64("last", F.pmod(F.xxhash64("rep"), F.ceil("held")))).alias("block"))
    rank = F.row_number().over(W.partitionBy("comp").orderBy(F.desc("degree"), "rep"))
    hubs = large.select("comp", "rep", "degree").withColumn("nr", rank).where(F.col("nr") <= HUBS).select("comp", "rep")
    everywhere = placed.select("comp", "block").distinct().join(hubs, "comp").select("rep", "block")
    return small.unionByName(placed.select("rep", "block")).unionByName(everywhere).distinct()


def _rest_blocks(groups: DataFrame, joined: DataFrame) -> DataFrame | None:
    """``(rep, sub, block)``: blocks in which all pairs of larger groups meet that are not connected yet.

    ``joined`` has the ``(node, component)`` found so far. No such group: None.
    """
    wide = 2 * KEY_VALUES
    groups = groups.withColumn("weight", F.lit(1.0) / BLOCK_ROWS + F.col("n_shingles") / BLOCK_SHINGLES)
    total = groups.groupBy("comp").agg(F.sum("weight").alias("all"), F.count("*").alias("n")).where("all > 2")
    named = groups.select("comp", "rep", "weight", "sig").join(total, "comp").join(joined, F.col("rep") == F.col("node"), "left")
    named = written(named.select("comp", "rep", "weight", "sig", "all", F.coalesce("component", "rep").alias("sub")), "rest-of-groups")
    if named.isEmpty():
        return None
    trees = named.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    near = trees.select("comp", "rep", "weight", "sub", "all", F.xxhash64("comp", "tree", F.expr(f"substring(sig, tree * {wide} + 1, {2 * FIRST_VALUES})")).alias("region"))
    # Work of a region: its size times what is outside its largest component. One region for the group if that is less.
    subs = near.groupBy("comp", "all", "region", "sub").agg(F.sum("weight").alias("w"))
    sizes = subs.groupBy("comp", "all", "region").agg(F.sum("w").alias("held"), F.max("w").alias("most"), F.max_by("sub", F.struct("w", "sub")).alias("base"), F.count("*").alias("subs"))
    sizes = written(sizes.where("subs > 1"), "regions")
    whole = named.groupBy("comp", "all", "sub").agg(F.sum("weight").alias("w")).groupBy("comp", "all").agg(
        F.max("w").alias("most"), F.max_by("sub", F.struct("w", "sub")).alias("base"), F.count("*").alias("subs")).where("subs > 1")
    cost = sizes.groupBy("comp").agg(F.sum(F.col("held") * (F.col("held") - F.col("most"))).alias("cost"))
    less = whole.join(cost, "comp").where(F.col("cost") > F.col("all") * (F.col("all") - F.col("most")))
    parts = lambda w: F.greatest(F.ceil(w), F.lit(1)).cast("int")
    cut = lambda rows, held: rows.select("region", "base", parts(held - F.col("most")).alias("few"), parts(F.col("most")).alias("many"))
    by_region = near.select("comp", "rep", "sub", "region").join(cut(sizes.join(less, "comp", "left_anti"), F.col("held")), "region").drop("comp")
    at_once = less.withColumn("region", F.xxhash64("comp", F.lit("whole")))
    by_group = named.select(F.xxhash64("comp", F.lit("whole")).alias("region"), "rep", "sub").join(cut(at_once, F.col("all")), "region")
    rows = by_region.select("region", "rep", "sub", "base", "few", "many").unionByName(by_group.select("region", "rep", "sub", "base", "few", "many"))
    # Parts 0 .. few - 1 lie outside the largest component and meet every part; the others meet only those.
    deal = lambda n: F.pmod(F.xxhash64("region", "rep"), F.col(n)).cast("int")
    dealt = rows.withColumn("part", F.when(F.col("sub") == F.col("base"), F.col("few") + deal("many")).otherwise(deal("few")))
    to = F.when(F.col("part") < F.col("few"), F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    met = dealt.select("region", "rep", "sub", "part", F.explode(to).alias("other"))
    return met.select("rep", "sub", F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other")).alias("block")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per document.

    Documents are linked when ``100 * intersection >= percent * union`` of their sets;
    ``component_id`` is the smallest key reachable. NULL, empty and blank texts have an
    empty set and stand alone, as do rows without a key (their ``component_id`` is NULL and
    they are kept). Repeated rows get equal results. Other columns are ignored. An empty
    table gives no rows. ``percent`` below 80 is refused: the candidates would not hold.
    """
    if percent < 80:
        raise ValueError("the candidate search is made for a similarity of 0.8 or more")
    rows = written(signatures(docs, key, text), "signatures")
    classes = written(
        rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("sig").alias("sig"), F.max("n_shingles").alias("n_shingles")),
        "classes",
    )
    first = _orders(classes.select("rep", "sig")).select("rep", F.xxhash64("tree", F.expr(f"substring(key, 1, {2 * FIRST_VALUES})")).alias("start"))
    shared = first.groupBy("start").agg(F.count("*").alias("n")).where("n > 1")
    meeting = first.join(shared, "start", "left_semi").select("rep").distinct()
    laid = _orders(classes.join(meeting, "rep").select("rep", "sig")).repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    met = written(laid.select("tree", "key", "rep", "sig").mapInArrow(lambda batches: _neighbours(batches, least_agreement(percent)), "rep long, root long, degree long"), "neighbours")
    loose = components(met, "rep", "root", "loose-groups")
    degree = met.groupBy("rep").agg(F.sum("degree").alias("degree"))
    groups = written(
        degree.join(loose.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep").join(classes.select("rep", "set_key", "sig", "n_shingles"), "rep"), "groups")
    blocks = _blocks(groups)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            wanted = batch.column(2).to_pylist()
            at, out = [], []
            for k, found in _sets(batch, 1, hashes):
                if _digest(found) == wanted[k]:  # equal keys may have other texts
                    at.append(k)
                    out.append(found.tobytes())
            take = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([take.column(0), take.column(3), pa.array(out, pa.binary())], names=["rep", "sig", "body"])

    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    wanted = groups.select("rep", "set_key", "sig").hint("shuffle_hash")
    sets = texts.join(wanted, "rep").select("rep", "t", "set_key", "sig").mapInArrow(bodies, "rep long, sig binary, body binary")

    def confirmed(dealt: DataFrame) -> DataFrame:
        laid = dealt.select("block", "rep", "sig", "body", "sub").repartition("block").sortWithinPartitions("block", "rep")
        return laid.mapInArrow(lambda batches: _confirm(batches, percent), "a long, b long")

    links = written(confirmed(sets.join(blocks, "rep").withColumn("sub", F.lit(None).cast("long"))), "confirmed")
    joined = components(links, label="near-duplicates")
    rest = _rest_blocks(groups, joined)
    if rest is not None:
        # Signatures meet first; full sets are sent only to blocks where something agrees with them.
        small = rest.join(groups.select("rep", "sig", "n_shingles"), "rep").select("block", "rep", "sub", "sig", "n_shingles")
        laid = small.repartition("block").sortWithinPartitions("block", "rep")
        agreeing = written(laid.mapInArrow(lambda batches: _agreeing(batches, percent), "rep long, sub long, block long"), "rest-agreeing")
        more = written(confirmed(sets.join(agreeing, "rep")), "confirmed-rest")
        if not more.isEmpty():
            joined = components(links.unionByName(more), label="near-duplicates")
    named = classes.select("set_key", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
        .select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )
