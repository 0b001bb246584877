"""Connected components of any size by alternating star operations on a table of links.

Each link ties a node `a` to a smaller node `b`. A large-star step passes every tie on to the least node that `b` itself is
tied to; a small-star step ties each node, and the others it was tied to, to the least of them. Both keep the
components, and rounds repeat until every node is tied to the smallest of its component, a number of rounds that grows with the
logarithm of the longest chain. A node to which very many are tied, or that is tied to very many, is a hot key of a join only; these
joins read written tables, so adaptive execution splits it. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import stored


def _round(spark: SparkSession, ties: DataFrame) -> DataFrame:
    least = stored(spark, ties.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least")), "least")
    large = stored(spark, ties.join(least, F.col("b") == F.col("of"), "left").select("a", F.coalesce("least", "b").alias("b")), "large")
    # A node may be tied to very many: its least is summed up first and joined back.
    smallest = stored(spark, large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("least")), "smallest")
    small = large.join(smallest, F.col("a") == F.col("of"))
    return small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("t")).select("t.*").where("a != b").distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node in the links (a, b), but for those that are their component's least."""
    ties = stored(spark, links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    seen = None
    while True:
        watch = Observation()
        counted = _round(spark, ties).observe(watch, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 31)).alias("sum"))
        ties = stored(spark, counted, "ties")
        now = (watch.get["n"], watch.get["sum"])
        if now == seen or not now[0]:
            return ties.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now
