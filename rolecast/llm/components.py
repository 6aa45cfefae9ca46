"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecast.llm.common import written

#: Links in a file of a round, so that small tables are not strewn over a file for each shuffle partition.
FILE_LINKS = 4096


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are hung on its smallest neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them. Rows have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "components") -> DataFrame:
    """``(node, component)``: the smallest node that each linked node reaches.

    Works in rounds of two joins over the links, each round saved to the shared
    folder in files of about ``FILE_LINKS`` links; all stars have one level once a round changes nothing. The number of links
    never grows, and it is counted first, so a saved table is best given; a node with many links is summed before the shuffle. Links with a
    NULL end and of a node to itself are left out; no links give no rows.
    """
    x, y = F.col(a), F.col(b)
    links = links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    files = links.count() // FILE_LINKS + 1
    now = written(links.distinct().coalesce(files), label)
    seen = None
    while True:
        now = written(_small_star(_large_star(now)).coalesce(files), label)
        # Exact sums of hashes: equal marks mean equal sets of links.
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
