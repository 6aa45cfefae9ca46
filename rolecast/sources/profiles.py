"""Profile readers: JSON lines (lenient or strict) and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecast.sources.schema import ARRAYS, CORRUPT, PARTS, normalise_arrays, reading_order, with_booleans


def read_profiles(spark: SparkSession, path: str, signals_field: str = "signals", note_odd: bool = False) -> DataFrame:
    """Well-formed lines of a JSONL file or folder; broken lines are left out.

    Lines are read as text and then parsed, because that decodes leniently:
    bytes that are not UTF-8 are replaced instead of losing the line. Blank
    lines vanish. ``ingest_ordinal`` orders rows as they stand in the input.
    Use ``read_rejected`` for the lines left out and ``note_odd`` for the parts of kept lines that lost
    elements (see ``parse_profiles``).
    """
    lines = spark.read.text(path).select("value", reading_order().alias("ingest_ordinal"))
    return parse_profiles(lines, "value", signals_field, note_odd).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_rejected(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """The malformed lines with their file, for a quarantine table."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    opened = _opened(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))
    # Whether a line is an object shows without its fields.
    found = opened.select("file", F.inline(F.array(F.struct(
        F.col("_line").alias("line"), (F.trim("_line") != "").alias("_written"),
        F.when(_alone(), F.try_variant_get("_json", "$[0]", "STRUCT<candidate_id: STRING>")).isNull().alias("_bad")))))
    return found.where("_written AND _bad").select("file", "line")


def read_profiles_strict(spark: SparkSession, path: str, signals_field: str = "signals") -> DataFrame:
    """Like ``read_profiles``, but the job fails at the first malformed line."""
    lines = spark.read.text(path).select("value", reading_order().alias("ingest_ordinal"))
    broken = F.concat(F.lit("malformed profile line: "), F.substring(CORRUPT, 1, 200))
    return parse_profiles(lines, "value", signals_field).where(F.when(F.col(CORRUPT).isNotNull(), F.raise_error(broken).cast("boolean")).otherwise(True)).drop(CORRUPT)


def parse_profiles(lines: DataFrame, column: str = "value", signals_field: str = "signals", note_odd: bool = False) -> DataFrame:
    """Parse a text column of JSON lines: parsed fields plus ``_corrupt_record``.

    A line is rejected unless it is one JSON object and nothing else; ``NaN`` and ``Infinity`` count as numbers and the
    last of two equal keys wins (the reader turns on ``spark.sql.variant.allowDuplicateKeys``
    for that). Each line is opened once, as a VARIANT, and every value is converted by itself: a value of
    another kind than expected is missing, and a stray element costs a list that element only. With ``note_odd``
    the array ``odd_parts`` names the parts that lost something in this way. Yes-no fields take true, numbers
    and words. Other columns are kept. Works on streams.
    """
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [c for c in lines.columns if c != column]
    line, opened, alone = F.col("_line"), _opened(lines, column), _alone()
    names = {name: signals_field if name == "signals" else name for name in PARTS}
    kind = ", ".join(f"`{names[name]}`: {kind.replace('BOOLEAN', 'STRING')}" for name, kind in PARTS.items())
    opened = opened.withColumn("_fields", F.when(alone, F.try_variant_get("_json", "$[0]", f"STRUCT<candidate_id: STRING, {kind}>")))
    fields = F.col("_fields")
    parts = [fields["candidate_id"].alias("candidate_id"), *[fields[names[name]].alias(name) for name in PARTS], F.when(fields.isNull(), line).alias(CORRUPT)]
    if note_odd:
        lost = [
            F.when(F.coalesce(F.try_variant_get("_json", f"$[0]['{names[name]}']", "variant").isNotNull() & fields[names[name]].isNull(), F.lit(False))
                   | (F.exists(fields[names[name]], lambda x: x.isNull()) if name in ARRAYS else F.lit(False)), F.lit(name))
            for name in PARTS
        ]
        parts.append(F.array_compact(F.array(*lost)).alias("odd_parts"))
    # A generator, so that a filter on parsed fields does not parse a second time, and one on blank lines does not make the lines twice.
    parsed = opened.select(*kept, F.inline(F.array(F.struct(*parts, (F.trim(line) != "").alias("_written")))))
    return normalise_arrays(with_booleans(parsed.where("_written").drop("_written")))


def _opened(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``_line`` in place of the column, ``_mark`` and ``_json``, the line and the mark as an array."""
    line = F.col("_line")
    opened = lines.select(*[c for c in lines.columns if c != column], F.col(column).alias("_line"))
    # Spark's parser stops behind the first value; between brackets, anything else on the line is seen.
    return opened.withColumn("_mark", F.xxhash64(line)).withColumn("_json", F.coalesce(_in_brackets(line), F.when(line.rlike("NaN|Infinity"), _in_brackets(_named_numbers(line)))))


def _alone() -> Column:
    return F.try_variant_get("_json", "$[1]", "bigint") == F.col("_mark")


def _in_brackets(line: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), F.col("_mark").cast("string"), F.lit("]")))


def _named_numbers(line: Column) -> Column:
    """The line with bare ``NaN`` and ``Infinity`` as texts; what stands inside a text is left alone."""
    pieces = F.regexp_extract_all(line, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]+|"'), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"-?\b(?:NaN|Infinity)\b", '"$0"'))), "")


def write_profiles(df: DataFrame, path: str) -> None:
    """Profiles as Parquet sorted by id within files: later reads prune columns,
    nested fields and row groups, which JSON cannot."""
    df.sortWithinPartitions("candidate_id").write.mode("overwrite").parquet(path)


def write_profile_store(df: DataFrame, path: str, row_group_bytes: int = 16 << 20, key: str = "candidate_id") -> None:
    """Profiles for reading single ids: dealt into ranges of the id, sorted, with Bloom filters.

    Each file and row group holds a narrow range of ids, so a reader that looks for a few of them skips the others
    by their bounds (``fetch_from_store``). Rows of one id lie together; a frequent or missing id is split over files.
    """
    numbered = df.withColumn("_nr", F.monotonically_increasing_id())
    sorted_rows = numbered.repartitionByRange(F.col(key).asc_nulls_first(), "_nr").sortWithinPartitions(F.col(key).asc_nulls_first())
    writer = sorted_rows.drop("_nr").write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
