"""Mixing sources to target weights.

The words of each source are summed, its share of the mix follows from its weight, and each
document is taken floor(rate) times plus one Bernoulli copy with probability equal to the rate's
fraction, where the rate is the source's target over its words. The draw is a hash of the document's id and
a seed, so no document is shuffled and every rerun takes the same copies. Draws of a source with a few very long documents
can miss its target by far; so each source uses that one of `SEEDS` seeds whose copies come nearest. What is
shuffled is sums per source and map task.

Defined results: null and empty texts have size 0 and are copied like others of their source;
a null source is a source of its own, the last; rows with equal ids share one draw; a source without
words has target 0 and is not taken; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, same, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source's size.
MOST = 3
#: Seeds that a source chooses from.
SEEDS = 16


def text_size(text: Column) -> Column:
    return F.regexp_count(filled(text), F.lit(WORD)).cast("long")


def source_targets(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, size).

    All sizes are shared out by weight. Targets above `most` times their source's size stop there,
    and the excess goes to the others by weight, until no target is above.
    """
    sums = stored(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    cycle = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stored(spark, _places(spark, sums).withColumn("weight", cycle).drop("place"), "source-weights")

    # With a share per unit of weight of `rest / left`, sources whose cap lies below stop at it.
    # The share only grows from round to round, so who has stopped stays stopped.
    rest = placed.agg(F.sum("source_size")).first()[0] or 0
    total, left, share = rest, None, None
    cap = F.col("source_size") * most
    while True:
        stopped = F.lit(False) if share is None else cap < F.col("weight") * F.lit(share)
        capped, weight = placed.agg(
            F.sum(F.when(stopped, cap).otherwise(0)), F.sum(F.when(stopped, 0).otherwise(F.col("weight")))
        ).first()
        if left == (capped, weight) or not weight:
            break
        left, rest = (capped, weight), total - capped
        share = rest / weight
    if not left:
        return placed.withColumn("target", F.lit(0.0))
    even = F.col("weight") * F.lit(float(rest)) / F.lit(float(left[1]))
    return stored(spark, placed.withColumn("target", F.when(cap < even, cap.cast("double")).otherwise(even)), "source-targets")


def _places(spark: SparkSession, sums: DataFrame) -> DataFrame:
    """Adds each source's place by code point from 0, null last, without one task that holds all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stored(spark, sums.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "source-order")
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    first = dealt.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(first, "part").select("source", "source_size", (F.col("first") + F.col("within")).alias("place"))


def copies(doc_id: Column, rate: Column, seed: Column) -> Column:
    """floor(rate), and one more where the document's draw is below the rate's fraction."""
    digits = F.substring(F.md5(F.concat(filled(doc_id.cast("string")), F.lit(":"), seed.cast("string"))), 1, 12)
    draw = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 48))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def source_rates(spark: SparkSession, sizes: DataFrame) -> DataFrame:
    """(of_source, source_size, target, rate, seed) of each source, from rows of (doc_id, source, size)."""
    targets = source_targets(spark, sizes.select("source", "size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("source").alias("of_source"), "source_size", "target", rate.alias("rate"))
    takes = [F.sum(F.col("size") * copies(F.col("doc_id"), F.col("rate"), F.lit(n))).alias(f"take_{n}") for n in range(SEEDS)]
    tried = sizes.join(rates, same(F.col("source"), F.col("of_source"))).groupBy("of_source", "source_size", "target", "rate").agg(*takes)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"take_{n}") - F.col("target")).alias("off"), F.lit(n).alias("seed")) for n in range(SEEDS)]))
    return stored(spark, tried.select("of_source", "source_size", "target", "rate", nearest["seed"].alias("seed")), "source-rates")


def _sizes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return stored(spark, docs.select("doc_id", "source", text_size(F.col("text")).alias("size")), "sizes")


def mix_plan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of each document."""
    sizes = _sizes(spark, docs)
    plan = sizes.join(source_rates(spark, sizes), same(F.col("source"), F.col("of_source")))
    plan = plan.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("seed")))
    return plan.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix itself: each row of `docs`, all its columns, as many times as it is taken."""
    rates = source_rates(spark, _sizes(spark, docs)).select("of_source", "rate", "seed")
    d, r = docs.alias("d"), rates.alias("r")
    n = copies(F.col("d.doc_id"), F.col("r.rate"), F.col("r.seed"))
    taken = d.join(r, same(F.col("d.source"), F.col("r.of_source"))).where(n > 0)
    return taken.select("d.*", F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("__copy")).drop("__copy")
