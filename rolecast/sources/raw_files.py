"""Ranked outputs as the bytes they are: encoding, records and cells of CSV files.

Spark's CSV reader decodes, skips blank lines and takes the header away before anybody can look. Here a file is one row
of bytes, cut into records at line breaks outside quotes and into cells at commas outside quotes.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Larger files are reported and not opened.
MOST_BYTES = 64 << 20
# A quote opens a cell only as its first sign; what follows the closing one belongs to the cell.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+|\z)|[^",\r\n][^,\r\n]*+|)'
_RECORD = rf"{_CELL}(?:,{_CELL})*+(?:\r\n|\n|\r|\z)"
_QUOTE = ""


def read_raw_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``(file, length, content)`` of each file; ``content`` is NULL above ``most_bytes``, such files are not read.

    Spark's readers skip files without a byte; they are added from the list of files that the reader has on the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one_slash = lambda name: re.sub(r"^([A-Za-z0-9+.-]+):/+", r"\1:/", name)
    listed = spark.createDataFrame([(one_slash(unquote(name)),) for name in files.inputFiles()], "file string")
    name = F.regexp_replace("path", "^([A-Za-z0-9+.-]+):/+", "$1:/").alias("file")
    small = files.where(F.col("length") <= most_bytes).select(name, "length", "content")
    large = files.where(F.col("length") > most_bytes).select(name, "length", F.lit(None).cast("binary").alias("content"))
    empty = listed.join(files.select(name), "file", "left_anti").select("file", F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content"))
    return small.unionByName(large).unionByName(empty)


def _value(cell: Column) -> Column:
    inner = F.regexp_replace(F.replace(F.substr(cell, F.lit(2)), F.lit('""'), F.lit(_QUOTE)), '^([^"]*)"', "$1")
    return F.when(cell.startswith('"'), F.replace(inner, F.lit(_QUOTE), F.lit('"'))).otherwise(cell)


def records(files: DataFrame) -> DataFrame:
    """``(file, nr, record, cells)`` of the readable files, in order from 0; an empty line has no cells."""
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "﻿")
    readable = files.where(F.col("content").isNotNull() & F.is_valid_utf8(F.col("content").cast("string")))
    found = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: r != "")
    rows = readable.select("file", F.posexplode(found).alias("nr", "raw"))
    rows = rows.select("file", F.col("nr").cast("long").alias("nr"), F.regexp_replace("raw", r"(?:\r\n|\n|\r)\z", "").alias("record"))
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "record"), F.lit(f",({_CELL})"), F.lit(1)), _value)
    return rows.withColumn("cells", F.when(F.col("record") == "", F.array().cast("array<string>")).otherwise(cells))
