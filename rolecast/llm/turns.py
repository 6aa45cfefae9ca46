"""Repair of conversations: faults, the cheapest edits, and the repaired text.

A conversation is right if its roles are an optional system turn and then pairs of user and assistant. The
cheapest edits are a shortest path over rows and four states (nothing yet, after the system
turn, after a user turn, after an assistant turn). The four least costs to the end, less the least of
them, take few different values, so the change that a block of ``BLOCK`` rows makes to them is
tabulated for every block of symbols (the four Russians' way): a conversation is walked from its
end by one lookup for each block. Blocks are then opened again, from the end of the block backward, to
follow the edits from the front; of equally cheap edits the first in the alphabet is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import written

BLOCK = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Anything but the six blanks of ASCII.
SOLID = r"[^\x20\x09-\x0D]"
FINE, BLANK, REPEAT, CUT = range(4)
INITIALS = "sua"  # a fourth one stands for all other roles
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
_FAR = 1 << 40
#: Where a kept row of each initial leads from each state; None: not allowed there.
_KEPT = {"s": {START: AFTER_SYSTEM}, "u": {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_ASSISTANT: AFTER_USER}, "a": {AFTER_USER: AFTER_ASSISTANT}}
#: The state behind the next user or assistant row that each state asks for.
_NEEDED = {START: AFTER_USER, AFTER_SYSTEM: AFTER_USER, AFTER_USER: AFTER_ASSISTANT, AFTER_ASSISTANT: AFTER_USER}


def row_code(fault: Column, role: Column) -> Column:
    """A letter from A for the fault and the initial of the role of a row."""
    initial = F.instr(F.lit(INITIALS), F.when(role == "", "-").otherwise(F.left(role, F.lit(1))))
    return F.char(65 + fault * 4 + F.when(initial == 0, 4).otherwise(initial) - 1)


def _symbol(letter: str) -> int:
    """0 to 7: initial, and 4 more for a truncated row; 8: a row that must go."""
    fault, initial = divmod(ord(letter) - 65, 4)
    return 8 if fault in (BLANK, REPEAT) else initial + 4 * (fault == CUT)


SYMBOLS = 9
_OF_LETTER = {chr(65 + k): _symbol(chr(65 + k)) for k in range(16)}


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row."""
    moves = [("D", DELETE, state)]
    if symbol < 8:
        more = TRUNCATED * (symbol >= 4)
        kept = _KEPT.get((INITIALS + "-")[symbol % 4], {}).get(state)
        if kept is not None:
            moves.append(("K", KEEP + more, kept))
        moves.append(("R", REROLE + more, _NEEDED[state]))
    return moves


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs when rows may also be inserted before."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEEDED[s]]) for s, c in enumerate(costs)]
    return costs


def _before(costs: list[int], symbol: int) -> list[int]:
    """Costs to the end in front of a row, from those behind it."""
    return _with_inserts([min(cost + costs[to] for _, cost, to in _moves(symbol, s)) for s in range(4)])


#: Costs behind the last row: only nothing at all or an assistant turn may end a conversation.
AT_END = tuple(_with_inserts([0, _FAR, _FAR, 0]))


class BlockTables:
    """For each normalised cost vector and each block of symbols: the vector in front of it and the added cost."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        step, added = [], []
        self.end, self.end_cost = self._normal(AT_END)
        at = 0
        while at < len(self.vectors):
            found = [self._normal(_before(list(self.vectors[at]), s)) for s in range(SYMBOLS)]
            step.append([f[0] for f in found])
            added.append([f[1] for f in found])
            at += 1
        self.step, self.added = np.array(step), np.array(added)
        # Symbol by symbol to the front; the first symbol of a block is the most significant digit.
        to, cost = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        for _ in range(block):
            to, cost = self.step[to].transpose(0, 2, 1).reshape(len(step), -1), (cost[:, :, None] + self.added[to]).transpose(0, 2, 1).reshape(len(step), -1)
        self.block_to, self.block_cost = to.tolist(), cost.tolist()
        self.step_to, self.step_cost = self.step.tolist(), self.added.tolist()
        self._opened: dict[tuple[int, int, int, int], tuple[str, int]] = {}

    def _normal(self, costs) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    def _open(self, symbols: tuple[int, ...], behind: int, state: int) -> tuple[str, int]:
        """Edits of a block and the state behind it, from the vector behind it."""
        costs = [list(self.vectors[behind])]
        for s in reversed(symbols):
            costs.append(_before(costs[-1], s))
        costs.reverse()
        out = []
        for k, s in enumerate(symbols):
            while True:
                here = costs[k][state]
                choices = [(letter, to, 0) for letter, cost, to in _moves(s, state) if cost + costs[k + 1][to] == here]
                if INSERT + costs[k][_NEEDED[state]] == here:
                    choices.append(("I", _NEEDED[state], 1))
                letter, state, stays = min(choices)
                out.append(letter)
                if not stays:
                    break
        return "".join(out), state

    def cheapest(self, letters: str) -> tuple[int, str]:
        """Least cost and edits of a conversation given by its rows' letters."""
        symbols = [_OF_LETTER[x] for x in letters]
        whole = len(symbols) // self.block * self.block
        vector, cost = self.end, self.end_cost
        for s in reversed(symbols[whole:]):
            cost += self.step_cost[vector][s]
            vector = self.step_to[vector][s]
        behind = [self.end, *([vector] if whole < len(symbols) else [])]
        weights = SYMBOLS ** np.arange(self.block - 1, -1, -1)
        codes = (np.array(symbols[:whole], np.int64).reshape(-1, self.block) @ weights).tolist()
        for code in reversed(codes):
            cost += self.block_cost[vector][code]
            vector = self.block_to[vector][code]
            behind.append(vector)
        cost += self.vectors[vector][START]
        behind.pop()  # the vector in front of everything
        parts, state = [], START
        for k, code in enumerate(codes):
            key = (code, self.block, behind[-1 - k], state)
            if key not in self._opened:
                self._opened[key] = self._open(tuple(symbols[k * self.block : (k + 1) * self.block]), behind[-1 - k], state)
            edits, state = self._opened[key]
            parts.append(edits)
        edits, state = self._open(tuple(symbols[whole:]), self.end, state)
        parts.append(edits)
        while state in (AFTER_SYSTEM, AFTER_USER):
            parts.append("I")
            state = _NEEDED[state]
        return cost, "".join(parts)


@lru_cache(maxsize=1)
def block_tables() -> BlockTables:
    """One per Python worker, shared by its tasks."""
    return BlockTables()


def damage(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as ``(conv, turn, role, text)``, damaged by a checksum of conversation and turn.

    NULL conversation and turn count as one space in the checksum and stay NULL; a NULL role or text becomes one space.
    Of every 20 checksums, 0 drops the row, 1 empties its text, 2 takes its sentence ends away, 3 repeats it, 4 makes it
    a user turn.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(x)) if c else F.lit(x) for c, x in ((conversation, " "), (None, ":"), (turn, " "))])
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    body = F.coalesce(F.col(text), F.lit(" "))
    out = rows.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), body.alias("text"), kind.alias("kind")).where("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows in the order of their conversations, saved, with a growing ``place`` and their parts.

    Ranges of the whole order are dealt to tasks, so a conversation of any size is spread over
    many of them. Equal turns go by role, the first 64 characters of the text and its digest; what is equal in all of these
    is alike, and split by its place in the input.
    """
    order = ["conv", "turn", "role", "head", "digest", "nr"]
    keyed = rows.withColumns({
        "head": F.left("text", F.lit(64)), "digest": F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), "nr": F.monotonically_increasing_id()
    })
    ranged = keyed.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return written(ranged.withColumn("place", F.monotonically_increasing_id()).drop("head", "nr"), "turns")


def _letters(ordered: DataFrame) -> DataFrame:
    """``(conv, letters)``: one letter for each row of a conversation, in order.

    The first row with each role and text is found by a sum that is begun before the shuffle and
    met again by its unique place, so no key is hot. Letters of one range are collected first; there is
    one row for each range of a conversation after that.
    """
    first = ordered.groupBy("conv", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    facts = ordered.select(
        "conv", "place", "role", (~F.col("text").rlike(SOLID)).alias("blank"),
        (~F.regexp_extract("text", rf"({SOLID})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")).alias("cut"),
    ).join(first, "place", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), REPEAT).when(F.col("cut"), CUT).otherwise(FINE)
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda s: s["c"]), "")
    ranges = facts.select("conv", F.shiftright("place", 33).alias("range"), F.struct("place", row_code(fault, F.col("role")).alias("c")).alias("x"))
    ranges = ranges.groupBy("conv", "range").agg(joined("x").alias("c"))
    return ranges.select("conv", F.struct("range", "c").alias("x")).groupBy("conv").agg(joined("x").alias("letters"))


def _solve(letters: DataFrame, kind: str) -> DataFrame:
    """Counts of faults, cost and edits of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = block_tables()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for text in batch.column(1).to_pylist():
                codes = np.frombuffer(text.encode(), np.uint8) - 65
                faults, initials = codes // 4, codes % 4
                pairs = initials[:-1] * 4 + initials[1:]
                legal = [INITIALS.index(p[0]) * 4 + INITIALS.index(p[1]) for p in ("su", "ua", "au")]
                values = [*[int((faults == f).sum()) for f in (BLANK, REPEAT, CUT)], int((~np.isin(pairs, legal)).sum()), *tables.cheapest(text)]
                for column, value in zip(out, values):
                    column.append(value)
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(out, kinds)]], names=_SOLVED)

    return letters.mapInArrow(run, f"conv {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_SOLVED = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def _repaired(ordered: DataFrame, solved: DataFrame, kind: str, whole: bool) -> DataFrame:
    """The repaired rows ``(conv, nr, edit, role, text)``, or with ``whole`` one digest ``(conv, sha256)``.

    The edits of a conversation go ahead of its rows through one stream; a task holds one batch of rows and
    the edits of one conversation.
    """
    edits = solved.select("conv", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    # Conversations stay together: a digest is made from the front to the end.
    stream = ordered.select("conv", "place", "role", "text").unionByName(edits).repartition("conv").sortWithinPartitions("conv", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        audit, at, nr, last, digest, conv = "", 0, 0, "", None, None

        def put(edit: str, role: str, text: str) -> None:
            nonlocal nr, last
            if whole:
                digest.update(("\n" if nr else "").encode() + f"{role}:{text}".encode())
            else:
                done.append((conv, nr, edit, role, text))
            nr, last = nr + 1, role[:1]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", "assistant" if last == "u" else "user", "")
                at += 1

        def finish() -> None:
            inserts()
            if whole and digest is not None:
                done.append((conv, digest.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(kinds)
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
            done.clear()
            return made

        key_type = None
        for batch in batches:
            if key_type is None:
                key_type = batch.schema.field(0).type
                names = ["conv", "sha256"] if whole else ["conv", "nr", "edit", "role", "text"]
                kinds = [key_type, pa.string()] if whole else [key_type, pa.int64(), pa.string(), pa.string(), pa.string()]
            keys = batch.column(0).to_pylist()
            for k, place in enumerate(batch.column(1).to_pylist()):
                role, text = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                if place < 0:
                    finish()
                    conv, audit, at, nr, last, digest = keys[k], text, 0, 0, "", hashlib.sha256()
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    put(edit, role, text)
                elif edit == "R":
                    put(edit, "assistant" if last == "u" else "user", text)
            yield batch_of()
        if key_type is not None:
            finish()
            yield batch_of()

    return stream.mapInArrow(run, f"conv {kind}, sha256 string" if whole else f"conv {kind}, nr long, edit string, role string, text string")


def _named(conversations: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )


def repair(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, nr, edit, role, text)``: the rows of each conversation after its cheapest repair.

    Edits are K (kept), R (role changed) and I (empty turn inserted); deleted rows are gone. Rows are taken by
    turn, NULL turns first, equal turns by role and text. Blank rows and rows whose role and text stood
    earlier are deleted; a row without an end of sentence costs one more if it stays. A NULL role or text is one space. Rows with a
    NULL conversation are one conversation; other columns are ignored; an empty table gives no rows. The edits of one conversation are one
    text, so they must fit a row; its rows never meet in memory.
    """
    kind = conversations.select(conversation).schema[0].dataType.simpleString()
    ordered = _in_order(_named(conversations, conversation, turn, role, text))
    return _repaired(ordered, _solve(_letters(ordered), kind), kind, whole=False)


def repair_report(damaged: DataFrame) -> DataFrame:
    """One row ``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` for each conversation of
    ``(conv, turn, role, text)``; see ``repair`` for the rules.

    ``gaps`` counts the turn numbers missing between the first and the last one. The digest is of the
    repaired rows as ``role:text`` joined by line breaks.
    """
    kind = damaged.schema["conv"].dataType.simpleString()
    ordered = _in_order(damaged)
    solved = written(_solve(_letters(ordered), kind), "turn-edits")
    turns = ordered.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    gaps = turns.select(F.col("conv").alias("c1"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))
    digests = _repaired(ordered, solved, kind, whole=True).select(F.col("conv").alias("c2"), F.col("sha256").alias("repaired_sha256"))
    both = solved.join(gaps, F.col("conv").eqNullSafe(F.col("c1"))).join(digests, F.col("conv").eqNullSafe(F.col("c2")))
    return both.select("conv", "gaps", *_SOLVED[1:], "repaired_sha256")


def damaged_report(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair_report`` of the damaged rows, with a row for every conversation there was.

    A conversation that lost all its rows has zeros, no edits and the digest of an empty text.
    """
    found = repair_report(damage(conversations, conversation, turn, role, text))
    all_of = conversations.select(F.col(conversation).alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_of.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *[zero(c) for c in ("gaps", *_SOLVED[1:6])], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
