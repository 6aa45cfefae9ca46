"""Audit of a ranked output: every violation becomes a row.

Result columns: ``check``, ``rank`` (text as found), ``candidate_id``,
``detail``. Row checks share one projection, repeat checks are pre-aggregated,
and the order checks use a range-sorted copy, so the audit also runs on a file
that is far too long or made of copies of one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecast.functions.scalars import strip, text_or
from rolecast.operators.ordered import previous_in_ranges, range_sorted
from rolecast.sources.raw_files import records

# Fixed output format.
HEADER = ("candidate_id", "rank", "score", "reasoning")
ID_PATTERN = r"^CAND_[0-9]{7}$"
EXPECTED_ROWS = 100
HONEYPOT_LIMIT = 0.10

_INTEGER = r"^(0|-?[1-9][0-9]*)$"
_FLOAT = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"
_RESULT = ("check", "rank", "candidate_id", "detail")


def _violation(check: str, when: Column, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), detail.alias("detail")))


def tidy(ranked: DataFrame) -> DataFrame:
    """The four columns as stripped text plus row order; blank rows dropped.

    ``_width`` is TRUE where a row had another number of cells.
    """
    wide = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in ranked.columns else F.lit(False)
    order = F.col("ingest_ordinal") if "ingest_ordinal" in ranked.columns else F.monotonically_increasing_id()
    cells = ranked.select(
        *[strip(text_or(F.col(c).cast("string"), "")).alias(c) for c in HEADER],
        wide.alias("_width"),
        order.alias("_order"),
    )
    return cells.where(F.col("_width") | (F.concat(*HEADER) != ""))


def _parsed(rows: DataFrame) -> DataFrame:
    """Well-formed rows with rank and score as numbers (NULL when invalid)."""
    return rows.where(~F.col("_width")).withColumns(
        {
            "_rank": F.when(F.col("rank").rlike(_INTEGER), F.col("rank").try_cast("bigint")),
            "_score": F.when(F.col("score").rlike(_FLOAT), F.col("score").try_cast("double")),
        }
    )


def audit_header(ranked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Are the column names and their order as required? Starts no scan."""
    found = columns if columns is not None else [c for c in ranked.columns if not c.startswith("_")]
    bad = tuple(found) != HEADER
    one = ranked.sparkSession.range(1)
    return one.where(F.lit(bad)).select(
        F.lit("header").alias("check"),
        F.lit(None).cast("string").alias("rank"),
        F.lit(None).cast("string").alias("candidate_id"),
        F.lit(f"expected {','.join(HEADER)}, found {','.join(found)}").alias("detail"),
    )


def audit_headers(lines: DataFrame) -> DataFrame:
    """Per file: is its first line the required header?

    ``lines`` comes from ``sources.tables.ranked_lines``. One row per file that
    fails, with the number of lines below the header.
    """
    first = lines.groupBy("file").agg(F.min_by("value", "position").alias("found"), (F.count("*") - 1).alias("n_lines"))
    expected = ",".join(HEADER)
    return first.where(F.col("found") != expected).select(
        F.lit("header").alias("check"),
        "file",
        F.concat(F.lit(f"expected {expected}, found "), "found").alias("detail"),
        "n_lines",
    )


def audit_files(files: DataFrame, extension: str = ".csv") -> DataFrame:
    """Per file: name, size, encoding and header, from the bytes (``sources.raw_files``). One row ``(check, file, detail)`` for each fault.

    A header cell in quotes counts like one without. Of a file that is too large or not UTF-8 nothing else is said.
    """
    header = records(files).where("nr = 0").select(F.col("file").alias("_file"), "cells")
    facts = files.select("file", "length", F.col("content").isNull().alias("large"), (~F.is_valid_utf8(F.col("content").cast("string"))).alias("broken")).join(
        header, F.col("file") == F.col("_file"), "left")
    fits = ~F.col("large") & ~F.coalesce("broken", F.lit(False))
    expected = F.array(*[F.lit(c) for c in HEADER])
    cells = F.coalesce("cells", F.array().cast("array<string>"))
    checks = F.array_compact(
        F.array(
            _violation("file_name", ~F.lower("file").endswith(extension), F.lit(f"expected a {extension} file")),
            _violation("file_size", F.col("large"), F.concat(F.col("length").cast("string"), F.lit(" bytes are not read"))),
            _violation("encoding", ~F.col("large") & F.col("broken"), F.lit("file is not UTF-8")),
            _violation("header", fits & F.col("cells").isNull(), F.lit("file is empty")),
            _violation("header", fits & F.col("cells").isNotNull() & (cells != expected), F.concat(F.lit(f"expected {','.join(HEADER)}, found "), F.array_join(cells, ","))),
        )
    )
    return facts.select("file", F.explode(checks).alias("v")).select(F.col("v.check").alias("check"), "file", F.col("v.detail").alias("detail"))


def ranked_records(files: DataFrame) -> DataFrame:
    """The data records of raw files in the shape that ``audit`` takes, with their ``file``.

    A record of another width keeps its raw text in ``_corrupt_record``, and of its cells those that are there.
    """
    data = records(files).where("nr > 0").where(F.exists("cells", lambda c: F.trim(c) != ""))
    return data.select(
        "file", F.struct("file", "nr").alias("ingest_ordinal"), *[F.get("cells", F.lit(k)).alias(c) for k, c in enumerate(HEADER)],
        F.when(F.size("cells") != len(HEADER), F.col("record")).alias("_corrupt_record"))


def audit_raw(files: DataFrame, extension: str = ".csv") -> DataFrame:
    """All violations of one ranked output given as raw files: those of its files, and if they can be read those of its rows."""
    whole = audit_files(files, extension).select("check", F.lit(None).cast("string").alias("rank"), F.lit(None).cast("string").alias("candidate_id"), "detail")
    return whole.unionByName(audit(ranked_records(files), list(HEADER)))


def audit_rows(rows: DataFrame) -> DataFrame:
    """Checks that look at one row: width, id format, rank, score."""
    ident, rank = F.col("candidate_id"), F.col("rank")
    parsed = rows.withColumn("_rank", F.when(rank.rlike(_INTEGER), rank.try_cast("bigint")))
    checks = F.array_compact(
        F.array(
            _violation("width", F.col("_width"), F.lit(f"expected {len(HEADER)} cells")),
            _violation("id_format", ~F.col("_width") & (ident == ""), F.lit("candidate_id is required")),
            _violation("id_format", ~F.col("_width") & (ident != "") & ~ident.rlike(ID_PATTERN),
                       F.lit("expected CAND_ and seven digits")),
            _violation("rank_valid", ~F.col("_width") & F.col("_rank").isNull(), F.lit("rank is not an integer")),
            _violation("rank_valid", ~F.col("_width") & ~F.col("_rank").between(1, EXPECTED_ROWS),
                       F.lit(f"rank is not within 1..{EXPECTED_ROWS}")),
            _violation("score_numeric", ~F.col("_width") & ~F.col("score").rlike(_FLOAT),
                       F.lit("score is not a number")),
        )
    )
    return parsed.select("rank", "candidate_id", F.explode_outer(checks).alias("v")).where("v IS NOT NULL").select(
        F.col("v.check").alias("check"), "rank", "candidate_id", F.col("v.detail").alias("detail")
    )


def audit_row_count(rows: DataFrame) -> DataFrame:
    n = F.col("n")
    return rows.agg(F.count("*").alias("n")).where(n != EXPECTED_ROWS).select(
        F.lit("row_count").alias("check"),
        F.lit(None).cast("string").alias("rank"),
        F.lit(None).cast("string").alias("candidate_id"),
        F.concat(F.lit(f"expected {EXPECTED_ROWS} rows, found "), n.cast("string")).alias("detail"),
    )


def _repeated(rows: DataFrame, key: str, check: str) -> DataFrame:
    counted = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    names = {"rank": "rank", "candidate_id": "candidate_id"}
    return counted.select(
        F.lit(check).alias("check"),
        *[(F.col(key) if c == key else F.lit(None)).cast("string").alias(c) for c in names],
        F.concat(F.lit("occurs "), F.col("n").cast("string"), F.lit(" times")).alias("detail"),
    )


def audit_id_unique(rows: DataFrame) -> DataFrame:
    """Well-formed ids that occur more than once, with their count."""
    return _repeated(rows.where(~F.col("_width") & F.col("candidate_id").rlike(ID_PATTERN)), "candidate_id", "id_unique")


def _valid_ranks(rows: DataFrame) -> DataFrame:
    return _parsed(rows).where(F.col("_rank").between(1, EXPECTED_ROWS))


def audit_rank_unique(rows: DataFrame) -> DataFrame:
    return _repeated(_valid_ranks(rows).select("rank"), "rank", "rank_unique")


def audit_rank_gaps(rows: DataFrame) -> DataFrame:
    expected = rows.sparkSession.range(1, EXPECTED_ROWS + 1).select(F.col("id").alias("_rank"))
    return expected.join(_valid_ranks(rows).select("_rank").distinct(), "_rank", "left_anti").select(
        F.lit("rank_gaps").alias("check"),
        F.col("_rank").cast("string").alias("rank"),
        F.lit(None).cast("string").alias("candidate_id"),
        F.lit("rank is missing").alias("detail"),
    )


def audit_counts(rows: DataFrame) -> DataFrame:
    """Row count, repeated ids, repeated and missing ranks from one scan and one aggregation.

    Every row gives up to three keys, which are summed before the shuffle; what must occur
    is added with a count of zero.
    """
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    facts = F.array_compact(
        F.array(
            fact("rows", F.lit("")),
            F.when(~F.col("_width") & F.col("candidate_id").rlike(ID_PATTERN), fact("id", F.col("candidate_id"))),
            F.when(~F.col("_width") & F.col("rank").rlike(_INTEGER) & F.col("rank").try_cast("bigint").between(1, EXPECTED_ROWS), fact("rank", F.col("rank"))),
        )
    )
    seen = rows.select(F.explode(facts).alias("f")).select("f.kind", "f.value", F.lit(1).cast("long").alias("n"))
    due = rows.sparkSession.range(EXPECTED_ROWS + 1).select(
        F.when(F.col("id") == 0, "rows").otherwise("rank").alias("kind"),
        F.when(F.col("id") == 0, "").otherwise(F.col("id").cast("string")).alias("value"),
        F.lit(0).cast("long").alias("n"),
    )
    kind, n = F.col("kind"), F.col("n")
    counted = seen.unionByName(due).groupBy("kind", "value").agg(F.sum("n").alias("n"))
    times = F.concat(F.lit("occurs "), n.cast("string"), F.lit(" times"))
    return counted.select(
        F.when(kind == "rows", F.when(n != EXPECTED_ROWS, "row_count"))
        .when(kind == "id", F.when(n > 1, "id_unique"))
        .when(n == 0, "rank_gaps")
        .when(n > 1, "rank_unique").alias("check"),
        F.when(kind == "rank", F.col("value")).alias("rank"),
        F.when(kind == "id", F.col("value")).alias("candidate_id"),
        F.when(kind == "rows", F.concat(F.lit(f"expected {EXPECTED_ROWS} rows, found "), n.cast("string")))
        .when(n == 0, "rank is missing").otherwise(times).alias("detail"),
    ).where(F.col("check").isNotNull())


def audit_order(rows: DataFrame) -> DataFrame:
    """Score must not rise with rank; equal scores go by ascending id."""
    return _order_violations(saved_in_order(rows))


def saved_in_order(rows: DataFrame) -> DataFrame:
    """All tidy rows by rank and then by their place, dealt into ranges and saved once.

    Rows that take no part in the order checks (``_rank`` or ``_score`` is NULL, no id) come first.
    """
    score = F.when(F.col("score").rlike(_FLOAT), F.col("score").try_cast("double"))
    rank = F.when(F.col("rank").rlike(_INTEGER), F.col("rank").try_cast("bigint"))
    usable = ~F.col("_width") & rank.isNotNull() & score.isNotNull() & (F.col("candidate_id") != "")
    marked = rows.withColumns({"_rank": F.when(usable, rank), "_score": F.when(usable, score)})
    return range_sorted(marked, [F.col("_rank").asc_nulls_first(), F.col("_order")])


def _order_violations(saved: DataFrame) -> DataFrame:
    pairs = previous_in_ranges(saved, ["_rank", "_score", "candidate_id"]).where("_rank IS NOT NULL")
    before = F.when(F.col("previous")["_rank"].isNotNull(), F.col("previous"))
    checks = F.array_compact(
        F.array(
            _violation("monotone", before["_score"] < F.col("_score"), F.lit("score is above that of the rank before")),
            _violation("tiebreak", (before["_score"] == F.col("_score")) & (before["candidate_id"] > F.col("candidate_id")),
                       F.lit("equal scores are not in order of candidate_id")),
        )
    )
    return pairs.select("rank", "candidate_id", F.explode_outer(checks).alias("v")).where("v IS NOT NULL").select(
        F.col("v.check").alias("check"), "rank", "candidate_id", F.col("v.detail").alias("detail")
    )


def audit_honeypot_share(ranked: DataFrame, verdicts: DataFrame, limit: float = HONEYPOT_LIMIT) -> DataFrame:
    """One row: share of honeypots among the ranked rows, and whether it fails.

    An inner join, so that the short side can be the one that is broadcast. The
    verdict is tested in the aggregate and not in a filter, which would be
    pushed into the screen and run its rules twice.
    """
    seen = ranked.select("candidate_id").join(verdicts.select("candidate_id", "is_honeypot"), "candidate_id")
    n_fakes = seen.agg(F.countDistinct(F.when(F.col("is_honeypot"), F.col("candidate_id")))).scalar()
    counted = ranked.agg(F.count("*").alias("n_ranked"))
    share = F.coalesce(F.try_divide(n_fakes, F.col("n_ranked")), F.lit(0.0))
    return counted.withColumn("share", share).withColumn("failed", F.col("share") > limit)


def audit(ranked: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All violations of a ranked output; empty when it is in order.

    The input is read once and dealt into ranges once (``saved_in_order``); all checks read the saved rows, and the order
    checks need only the last row of each range besides.
    """
    saved = saved_in_order(tidy(ranked))
    result = audit_header(ranked, columns)
    for part in (audit_counts(saved), audit_rows(saved), _order_violations(saved)):
        result = result.unionByName(part.select(*_RESULT))
    return result
