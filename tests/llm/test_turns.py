"""Conversation repair against a plain shortest path and plain Python over all conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rolecast.llm import queries, turns

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn int, role string, text string, place string, c int, letters string"
EMPTY = hashlib.sha256(b"").hexdigest()
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """(cost, audit, repaired) of (role, text) rows by recursion; also their faults."""
    faults, seen = [], set()
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    full = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(k, state, inserted):
        found = []
        if inserted < 2:  # more than two in a row only go round
            cost, audit, out = best(k, NEXT[state], inserted + 1)
            found.append((cost + 2, "I" + audit, ((full[NEXT[state]], ""), *out)))
        if k == len(rows):
            if state in "0a":
                found.append((0, "", ()))
            return min(found) if found else (10**9, "", ())
        (role, text), fault = rows[k], faults[k]
        cost, audit, out = best(k + 1, state, 0)
        found.append((cost + 3, "D" + audit, out))
        if fault not in ("blank", "duplicate"):
            more = int(fault == "truncated")
            if (role[:1], state) in (("s", "0"), ("u", "0"), ("u", "s"), ("u", "a"), ("a", "u")):
                cost, audit, out = best(k + 1, role[:1], 0)
                found.append((cost + more, "K" + audit, ((role, text), *out)))
            cost, audit, out = best(k + 1, NEXT[state], 0)
            found.append((cost + 2 + more, "R" + audit, ((full[NEXT[state]], text), *out)))
        return min(found)

    return (*best(0, "0", 0), faults)


def plain_report(rows):
    """The query in plain Python; rows are (conv_id, turn, role, text)."""
    out = {}
    damaged = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        found = damaged.get(conv, [])
        if not found:
            out[conv] = (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        numbers = {t for t, *_ in found if t is not None}
        cost, audit, repaired, faults = plain_repair(tuple((r, t) for _, r, t in found))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest(),
        )
    return out


def plain_damage(rows):
    """The damaged rows (turn, role, text) of each conversation, in order."""
    damaged = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        damaged.setdefault(conv, []).extend([(turn, role, text)] * (2 if kind == 3 else 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: sorted(found, key=order) for conv, found in damaged.items()}


ROLES = ["system", "user", "assistant", "tool", " ", "", "unknown"]
TEXTS = ["Yes.", "No", " ", "", "Go on! ", "What?\n", "x"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(TEXTS), st.integers(0, 4)), max_size=14))
def test_blocks_give_the_cheapest_edits(rows):
    rows = tuple((r, f"{n}{t}" if t.strip() else t) for r, t, n in rows)
    cost, audit, _, faults = plain_repair(rows)
    number = {"": turns.FINE, "blank": turns.BLANK, "duplicate": turns.REPEAT, "truncated": turns.CUT}
    letters = "".join(chr(65 + 4 * number[f] + (turns.INITIALS + "-").index(r[:1] if r[:1] in tuple(turns.INITIALS) else "-")) for (r, _), f in zip(rows, faults))
    assert turns.block_tables().cheapest(letters) == (cost, audit)


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_block_length_changes_nothing(block):
    draw, other = random.Random(block), turns.BlockTables(block)
    assert len(other.vectors) < 100
    for n in (0, 1, 4, 5, 17, 300):
        letters = "".join(draw.choices("ABCDMNOPEF", k=n))
        assert other.cheapest(letters) == turns.block_tables().cheapest(letters)


def as_rows(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def test_query_is_that_of_plain_python(spark):
    found = as_rows(queries.QUERIES["op11_conversation_repair"](spark, SF))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found == plain_report(rows)


def test_odd_rows(spark):
    draw = random.Random(8)
    rows = [(draw.choice([None, 1, 2, 3, 4, 5]), draw.choice([None, *range(9)]), draw.choice([None, *ROLES]), draw.choice([None, *TEXTS])) for _ in range(150)]
    rows += [(6, k, ROLES[1 + k % 2], f"{'long words ' * 3000}{k}.") for k in range(6)] + [(7, None, None, None)] + [(9, 5, "user", "Same.")] * 40
    gone = next(c for c in range(100, 999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Nothing of this stays.")]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    made = turns.damaged_report(frame)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = as_rows(made)
    assert found == plain_report(rows) and found[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    nothing = frame.where("false")
    assert turns.damaged_report(nothing).count() == 0 and turns.repair(nothing).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "tool", "Out."), (1, 3, "user", "Hi."), (2, 0, "system", "Be good."), (2, 1, "assistant", "I am."), (3, 0, "x", "")]
    made = turns.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    by = {c: [tuple(r)[2:] for r in made.where(f"conv = {c}").orderBy("nr").collect()] for c in (1, 2, 3)}
    for c in (1, 2, 3):
        _, audit, repaired, _ = plain_repair(tuple((r, t) for k, _, r, t in rows if k == c))
        assert [(r, t) for _, r, t in by[c]] == list(repaired) and [e for e, *_ in by[c]] == [a for a in audit if a != "D"]


def test_one_long_conversation_is_spread_over_ranges(spark):
    rows = [(5, k, ("user", "assistant")[k % 2], f"line {k % 700}.") for k in range(4000)] + [(k, 0, "user", "Hi.") for k in range(100, 140)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordered = turns._in_order(turns.damage(frame))
        assert ordered.where("conv = 5").selectExpr("shiftright(place, 33) r").distinct().count() > 2
        found = as_rows(turns.damaged_report(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {k: v for k, v in found.items() if k != 5} == plain_report([r for r in rows if r[0] != 5])
    kept, least, seen, repeats = "", {"0": 0}, set(), 0
    cost, audit = found[5][5:7]
    edits = iter(audit)
    for _, role, text in plain_damage([r for r in rows if r[0] == 5])[5]:
        repeat = (role, text) in seen
        repeats += repeat and bool(text)
        cut = text and text[-1] != "."
        after = {}
        for _ in range(3):
            least = {s: min([c, *[d + 2 for t, d in least.items() if NEXT[t] == s]]) for s, c in {**{NEXT[t]: 10**9 for t in least}, **least}.items()}
        for state, paid in least.items():
            moves = [(state, 3)]
            if text and not repeat:
                moves += [(NEXT[state], 2 + bool(cut))] + ([(role[0], int(bool(cut)))] if NEXT[state] == role[0] else [])
            for to, more in moves:
                after[to] = min(after.get(to, 10**9), paid + more)
        least = after
        seen.add((role, text))
        while (edit := next(edits)) == "I":
            kept += NEXT[kept[-1:] or "0"]
        assert edit == "D" or (text and not repeat)
        kept += "" if edit == "D" else role[0] if edit == "K" else NEXT[kept[-1:] or "0"]
    assert found[5][2] == repeats > 2000 and cost == min(least.get("a", 10**9), least.get("0", 10**9), least.get("u", 10**9) + 2)
    assert set(edits) <= {"I"} and re.fullmatch("s?(ua)*", kept + "a" * (kept[-1:] == "u"))
