"""Secret scan with multipart credential linking, in DataFrame functions only.

Base patterns give three kinds of spans. Beyond them, a weak candidate (a long mixed token,
or the address of a service) proves nothing alone; it is reported when a
complementary part stands within its scope: access identifiers take the tokens and addresses
up to ``SCOPE`` characters around them, assigned and hex secrets the addresses. A token and an
address alone are both weak and prove nothing. The parts are rows; they meet in an interval join
by cells of the scope's size, so a document full of parts is many small groups.

Spans are found without Python: each match is wrapped in private-use characters (first
replaced in the text by another one of the same length, so places do not change), the text
is split there, and the pieces' lengths give the places in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds and their patterns. Group 1 leads to the value, group 2 is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
# The last two are runs of one class, so their least lengths may stand in the pattern:
# a run that fails holds no match that succeeds.
ACCESS = r"()(AKIA[A-Z0-9]{12,})"
HEX = r"()([0-9a-f]{32,})"
KINDS = (("assign", ASSIGN, 8), ("access", ACCESS, 16), ("hex", HEX, 32))

# The method's own parts.
MATERIAL = r"()((?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-]))"
ENDPOINT = r"((?i:https?|s3|ftp|jdbc:[a-z]+)://)([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?)"
PARTS = (("material", MATERIAL), ("endpoint", ENDPOINT))
SCOPE = 400

_OPEN, _VALUE, _CLOSE, _SPARE = "\ue000", "\ue001", "\ue002", "\ue003"
_NONE = "array<struct<start: int, end: int>>"


def spans(text: Column, pattern: str, least: int) -> Column:
    """``array<struct<start, end>>`` of all leftmost matches whose value has ``least`` characters or more.

    ``text`` must not hold the marking characters (see ``unmarked``). Without a match: empty.
    One pass over the pieces: each but the first is lead, mark, value, mark, rest; so
    the two groups of a pattern must hold the whole match. Pieces are folded ``_RUN`` at a time and the
    runs are then shifted to their places, so the work stays in proportion to the number of spans.
    """
    first = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        value, close = F.instr(piece, _VALUE), F.instr(piece, _CLOSE)
        match = F.struct(acc["at"].alias("start"), (acc["at"] + close - 2).cast("int").alias("end"))
        return F.struct(
            (acc["at"] + F.char_length(piece) - F.when(close > 0, 2).otherwise(0)).alias("at"),
            F.when((close > 0) & (close - value - 1 >= least), F.concat(acc["out"], F.array(match))).otherwise(acc["out"]).alias("out"),
        )

    def shift(acc: Column, run: Column) -> Column:
        placed = F.struct(acc["at"].alias("at"), run["out"].alias("out"))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(placed)).alias("out"))

    runs = F.transform(_runs(F.split(F.regexp_replace(text, pattern, f"{_OPEN}$1{_VALUE}$2{_CLOSE}"), _OPEN)), lambda run: F.aggregate(run, first, step))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at: int, out: {_NONE}>>").alias("out"))
    placed = F.aggregate(runs, start, shift, lambda acc: acc["out"])
    return F.flatten(F.transform(placed, lambda run: F.transform(run["out"], lambda s: F.struct((s["start"] + run["at"]).alias("start"), (s["end"] + run["at"]).alias("end")))))


_RUN = 256


def _runs(values: Column) -> Column:
    """An array cut into arrays of ``_RUN`` elements. The array is bound to a name, so that it is built once."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / _RUN).cast("int")), lambda k: F.slice(v, k * _RUN + 1, F.lit(_RUN)))
    return F.flatten(F.transform(F.array(values), cut))


def unmarked(text: Column) -> Column:
    """The text (NULL: empty) with marking characters replaced by one that no pattern takes."""
    whole = F.coalesce(text, F.lit(""))
    marked = F.contains(whole, F.lit(_OPEN)) | F.contains(whole, F.lit(_VALUE)) | F.contains(whole, F.lit(_CLOSE))
    return F.when(marked, F.translate(whole, _OPEN + _VALUE + _CLOSE, _SPARE * 3)).otherwise(whole)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """All columns of ``docs`` with ``base`` and ``linked``: arrays of ``(kind, start, end)``.

    ``base`` holds the fixed kinds, by start and then in the order of the kinds; ``linked`` the
    parts of kind ``material`` that an access identifier, and of kind ``endpoint`` that a
    part of any base kind, within ``scope`` characters makes credible. Places are code points, the end exclusive. Columns of
    ``docs`` with these two names are replaced. NULL text is empty; a NULL key and
    repeated rows are allowed, as parts meet by key and digest of the text. An empty table
    gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("base", "linked")]
    clean = docs.select(*kept, unmarked(F.col(text)).alias("_clean"))
    hit = {  # cheap tests that spare most texts the marking
        "assign": F.col("_clean").rlike("(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]"),
        "access": F.contains("_clean", F.lit("AKIA")),
        "hex": F.col("_clean").rlike("[0-9a-f]{32}"),
    }
    empty = F.lit(None).cast(_NONE)
    base = [F.when(hit[kind], spans(F.col("_clean"), pattern, least)).otherwise(empty).alias(f"_{kind}") for kind, pattern, least in KINDS]
    # A weak part counts only in a text with its anchor: others are not searched.
    address = F.contains("_clean", F.lit("://"))
    may = {"material": hit["access"], "endpoint": address & (hit["access"] | hit["assign"] | hit["hex"])}
    weak = [F.when(may[kind], spans(F.col("_clean"), pattern, 1)).otherwise(empty).alias(f"_{kind}") for kind, pattern in PARTS]
    found = clean.select(*kept, F.when(may["material"] | may["endpoint"], F.sha2("_clean", 256)).alias("_digest"), *base, *weak)

    one = lambda kind: F.transform(F.coalesce(f"_{kind}", F.array().cast(_NONE)), lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))
    by_place = lambda column: F.array_sort(column, lambda a, b: F.when(a.start != b.start, a.start - b.start).when(a.kind != b.kind, _kind_order(a.kind) - _kind_order(b.kind)).otherwise(0))
    merged = by_place(F.concat(*[one(kind) for kind, _, _ in KINDS]))

    # The plain search comes first: it spares all other texts the rest.
    size = lambda kind: F.coalesce(F.size(f"_{kind}"), F.lit(0))
    anchored = (size("access") > 0) & (size("material") > 0) | (size("endpoint") > 0) & (F.size(merged) > 0)
    both = found.where(F.contains(F.col(text), F.lit("AKIA")) | F.contains(F.col(text), F.lit("://"))).where(anchored).select(
        F.col(key).alias("k"), F.col("_digest").alias("d"), merged.alias("_anchors"), "_material", "_endpoint").distinct()
    access = both.select("k", "d", F.explode("_anchors").alias("s")).select("k", "d", "s.*")
    cells = access.select("k", "d", "kind", F.col("start").alias("low"), F.col("end").alias("high"), F.explode(F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))).alias("cell"))
    parts = both.select("k", "d", F.explode(F.concat(one("material"), one("endpoint"))).alias("s")).select("k", "d", "s.*").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))))
    near = F.col("p.k").eqNullSafe(F.col("a.k")) & (F.col("p.d") == F.col("a.d")) & (F.col("p.cell") == F.col("a.cell"))
    near &= (F.col("p.kind") == "endpoint") | (F.col("a.kind") == "access")
    near &= (F.col("p.start") <= F.col("a.high") + scope) & (F.col("p.end") >= F.col("a.low") - scope)
    near &= (F.col("p.start") >= F.col("a.high")) | (F.col("p.end") <= F.col("a.low"))
    linked = parts.alias("p").join(cells.alias("a"), near, "left_semi").drop("cell").distinct()
    lists = linked.groupBy("k", "d").agg(by_place(F.collect_list(F.struct("kind", "start", "end"))).alias("linked")).select(F.col("k").alias("_k"), F.col("d").alias("_d"), "linked")
    rows = found.select(*kept, "_digest", merged.alias("base"))
    joined = rows.join(lists, (F.col("_digest") == F.col("_d")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    nothing = F.array().cast("array<struct<kind: string, start: int, end: int>>")
    return joined.select(*kept, "base", F.coalesce("linked", nothing).alias("linked"))


def _kind_order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x, *_ in (*KINDS, *PARTS)]), kind).cast("int")


def all_spans() -> Column:
    """``base`` and ``linked`` together, by start and then by kind."""
    return F.array_sort(F.concat("base", "linked"), lambda a, b: F.when(a.start != b.start, a.start - b.start).otherwise(_kind_order(a.kind) - _kind_order(b.kind)))


def as_text(column: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by ``mask``.

    ``found`` is sorted by start, as ``all_spans`` gives it. Places are looked up in the part of the text that
    ``_RUN`` spans cover, not in the whole text each time.
    """
    first = lambda at: F.struct(at.alias("at"), F.lit("").alias("out"))

    def step(base: Column, part: Column):
        def one(acc: Column, s: Column) -> Column:
            fresh = s.start >= acc["at"]
            return F.struct(
                F.greatest(acc["at"], s.end).alias("at"),
                F.when(fresh, F.concat(acc["out"], F.substring(part, acc["at"] - base + 1, s.start - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"),
            )

        return one

    def run_step(acc: Column, run: Column) -> Column:
        base = acc["at"]
        part = F.substring(text, base + 1, F.array_max(F.transform(run, lambda s: s.end)) - base)
        # The part is bound to a name, so that it is cut out once.
        done = F.element_at(F.transform(F.array(part), lambda p: F.aggregate(run, first(base), step(base, p))), 1)
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), 1)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(_runs(found), start, run_step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
