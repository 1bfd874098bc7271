"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorevine.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, root): every node with an edge, and the least node it reaches.

    Each round points nodes at the least neighbour, by combinable minima and joins, and is
    cut by a checkpoint; rounds end when no edge changes, after about log n of them.
    Nothing but a count and a checksum of the edges comes to the driver.
    """
    now = common.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while True:
        rows = 2 * mark[0]
        both = common.few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = common.few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows)
        large = common.few(large.distinct(), rows)
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = common.few(small.unionByName(lower.select("u", F.col("m").alias("v"))), rows)
        now = common.cut(common.few(now.distinct(), rows))
        old, mark = mark, _mark(now)
        if mark == old:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
