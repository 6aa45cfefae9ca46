"""The fraud screen and the scores on a stream.

Everything up to the final score looks at one row only, so the batch
operators run unchanged on a streaming frame in append mode, without state. Only the removal of repeated
ids keeps a state.
Ranking needs the whole table and stays a batch job over the written rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rolecast.config import DEFAULT, Config
from rolecast.operators.features import feature_table
from rolecast.operators.posting import Criteria
from rolecast.operators.score import add_final_score
from rolecast.operators.screen import validate_batch
from rolecast.sources.profiles import parse_profiles
from rolecast.sources.schema import CORRUPT


def screen_stream(profiles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Verdicts for a streaming profile frame."""
    return validate_batch(profiles, config)


def score_stream(profiles: DataFrame, criteria: Criteria, config: Config = DEFAULT) -> DataFrame:
    """Feature rows with final_score for a streaming profile frame."""
    return add_final_score(feature_table(profiles, criteria, config), config)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row: its task, then its place there (streams have no function for that). To rows without an id also a mark of their own."""
    from pyspark import TaskContext

    task = TaskContext.get()
    at, arrived = task.partitionId() << 33, str(task.getLocalProperty("streaming.sql.batchId"))
    for batch in batches:
        places = pa.array(range(at, at + batch.num_rows), pa.int64())
        marks = pc.if_else(pc.is_null(batch.column("_id")), pc.binary_join_element_wise(arrived, places.cast(pa.string()), "-"), None)
        yield pa.RecordBatch.from_arrays([*batch.columns, places, marks], names=[*batch.schema.names, "_place", "_mark"])
        at += batch.num_rows


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each ``_id`` the row with the lowest ``_place``, and rows without one. Only these two stay in memory; the rows wait in a file of the task."""
    ids, places = [], []
    with tempfile.TemporaryFile() as file:
        for batch in batches:
            if not ids:
                rows = pa.ipc.new_stream(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
            rows.write_batch(batch)
            ids.append(batch.column("_id").cast(pa.large_string()))
            places.append(batch.column("_place").to_numpy())
        if not ids:
            return
        rows.close()
        file.seek(0)
        codes = pa.concat_arrays(ids).dictionary_encode().indices.fill_null(-1).to_numpy()
        order = np.lexsort((np.concatenate(places), codes))
        first = codes == -1
        first[order[np.flatnonzero(np.diff(codes[order], prepend=-1))]] = True
        at = 0
        for batch in pa.ipc.open_stream(file):
            yield batch.filter(pa.array(first[at : at + batch.num_rows]))
            at += batch.num_rows


def _first_of_each(rows: DataFrame) -> DataFrame:
    """Of a stream of rows with an ``_id``, the first one of each, and all rows without one; sent twice, so they should be short.

    Rows that arrive together are compared by their places. What is left has one row for each id, and Spark's own state
    drops those that came before.
    """
    numbered = rows.mapInArrow(_numbered, StructType([*rows.schema, StructField("_place", LongType()), StructField("_mark", StringType())]))
    first = numbered.repartition("_id", "_mark").mapInArrow(_first_rows, numbered.schema)
    return first.dropDuplicates(["_id", "_mark"]).drop("_id", "_place", "_mark")


def _named(lines: DataFrame, column: str) -> DataFrame:
    """The lines as ``value`` and ``_id``, which is NULL for those without an id, or that are no JSON."""
    known = F.try_variant_get(F.try_parse_json(F.col(column)), "$.candidate_id", "string")
    # A generator, so that a filter on the id does not look for it a second time.
    return lines.select(F.inline(F.array(F.struct(F.col(column).alias("value"), known.alias("_id")))))


def first_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Of a stream of JSON lines, the first one of each id; ``value`` is all that is kept.

    An id is known by a state once a line of it has come, so repeats in later files are dropped; of lines that arrive together the
    one that was read first stays. Lines without an id, or that are no JSON, pass. The state holds
    every id seen: use the RocksDB state store for many.
    """
    named = _named(lines, column)
    return _first_of_each(named.where("_id IS NOT NULL")).unionByName(named.where("_id IS NULL").select("value"))


def screen_new_lines(lines: DataFrame, signals_field: str = "signals", config: Config = DEFAULT) -> DataFrame:
    """Verdicts for a stream of JSON lines, one for each id: that of its first line (see ``first_lines``).

    A verdict is much shorter than its line, so lines are screened where they are read and only verdicts are sent
    to find the first of each id. The first line of an id counts even where it is rejected. A profile without an id passes, but
    leaves a mark in the state: to go round the state it would have to be screened by a second copy of the plan.
    """
    parsed = parse_profiles(_named(lines, "value"), "value", signals_field).withColumn("_whole", F.col(CORRUPT).isNull()).drop(CORRUPT)
    verdicts = validate_batch(parsed.where("_whole OR _id IS NOT NULL"), config, keep=("_id", "_whole"))
    return _first_of_each(verdicts).where("_whole").drop("_whole")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer for all available input; start it with ``.start()``."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
