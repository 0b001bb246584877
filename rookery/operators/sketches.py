"""Distinct users over any period, from one small sketch per day.

A day's sketch (HyperLogLog) is a few kilobytes whatever the number of users, and sketches of days are merged to those of weeks and quarters without reading
the events again. Late events need no open state: their sketch is merged into their day's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A sketch has 2^14 registers, so the standard error of a count is 1.04 / 2^7, below one percent.
REGISTERS_LOG2 = 14
STANDARD_ERROR = 1.04 / 2 ** (REGISTERS_LOG2 / 2)
GRAINS = ("day", "week", "month", "quarter", "year")


def daily_sketches(acts: DataFrame) -> DataFrame:
    """(day, users) from (user_id, time): a sketch of each UTC day's distinct users."""
    sketch = F.hll_sketch_agg("user_id", REGISTERS_LOG2)
    return acts.groupBy(F.to_date("time").alias("day")).agg(sketch.alias("users"))


def period(day: Column, grain: str) -> Column:
    """The first day of the day's period; weeks begin on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}, use one of {GRAINS}")
    return F.to_date(F.date_trunc(grain, day))


def merged_sketches(sketches: DataFrame, grain: str = "day") -> DataFrame:
    """(start, users): one sketch per period, from sketches of days, several per day included."""
    return sketches.groupBy(period(F.col("day"), grain).alias("start")).agg(F.hll_union_agg("users").alias("users"))


def active_users(sketches: DataFrame, grain: str = "day") -> DataFrame:
    """(start, active_users): the estimated distinct users of each period."""
    return merged_sketches(sketches, grain).select("start", F.hll_sketch_estimate("users").alias("active_users"))


def stream_daily_sketches(acts: DataFrame, path: str) -> StreamingQuery:
    """Write a sketch per day and batch of a stream of (user_id, time); a repeated batch overwrites its own."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        daily_sketches(batch).write.mode("overwrite").parquet(f"{path}/sketches/batch_id={batch_id}")

    return (
        acts.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    """(day, users), with as many rows per day as batches had events of it."""
    return spark.read.schema("day date, users binary").parquet(f"{path}/sketches")
