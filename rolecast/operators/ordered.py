"""Positions and neighbours in a total order, without a one-task window.

A window without partition keys sends the whole table to one task, and a
window per key sends a hot key there. Here the rows are range-partitioned on
the complete sort key, so that ties on its first columns are spread as well,
and saved with ``checkpoint``; partition bounds and rows then stay the same
however often they are read or recomputed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from rolecast.session import checkpoint_root

_POSITION_BITS = 33


def range_sorted(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Rows sorted across partitions, with ``_part`` and ``_pos``. Runs a job."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_root(spark)
    # The last key splits rows that agree on all given keys.
    keys = [*order, F.col("_tie")]
    laid = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("_tie")
        .checkpoint()
    )
    return laid.withColumns(
        {
            "_part": F.shiftright("_row", _POSITION_BITS),
            "_pos": F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)),
        }
    ).drop("_row")


def with_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank 1..n over the whole table."""
    rows = range_sorted(df, order)
    # One row per partition, so this window and broadcast stay small.
    before = rows.groupBy("_part").count().select(
        "_part",
        F.coalesce(F.sum("count").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    return (
        rows.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_pos") + 1)
        .drop("_part", "_pos", "_before")
    )


def with_previous(df: DataFrame, order: Sequence[Column], columns: Sequence[str], name: str = "previous") -> DataFrame:
    """Add the given columns of the preceding row as a struct."""
    return previous_in_ranges(range_sorted(df, order), columns, name).drop("_part", "_pos")


def previous_in_ranges(rows: DataFrame, columns: Sequence[str], name: str = "previous") -> DataFrame:
    """``with_previous`` for rows that ``range_sorted`` has saved: nothing is shuffled again.

    Each saved range is read in its order and hands every row on with the one before. The first row of a range takes the
    last row of the range before, from a summary of one row per range.
    """
    kept = rows.columns
    kinds = {f.name: f.dataType for f in rows.schema}
    value = StructType([StructField(c, kinds[c]) for c in columns])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(kept.index(c)) for c in columns]
            before = [pa.nulls(1, x.type) for x in now] if last is None else last
            shifted = [pa.concat_arrays([b, x.slice(0, len(x) - 1)]) for b, x in zip(before, now)]
            known = pa.array([last is not None] + [True] * (len(now[0]) - 1))
            pairs = pa.StructArray.from_arrays(shifted, names=list(columns), mask=pc.invert(known))
            last = [x.slice(len(x) - 1, 1) for x in now]
            yield pa.RecordBatch.from_arrays([*batch.columns, pairs], names=[*kept, "_inside"])

    inside = rows.mapInArrow(shift, StructType([*rows.schema.fields, StructField("_inside", value)]))
    last = rows.groupBy("_part").agg(F.max_by(F.struct(*columns), "_pos").alias("_last"))
    carried = last.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_carried"))
    return inside.join(F.broadcast(carried), "_part").withColumn(name, F.coalesce("_inside", "_carried")).drop("_inside", "_carried")
