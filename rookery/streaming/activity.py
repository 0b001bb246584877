"""Daily active users over a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_active_stream(acts: DataFrame, late_days: int = 1) -> DataFrame:
    """Active users per closed UTC day of a stream of (user_id, time).

    A day stays open for late events until an event `late_days` past its end is seen; it is
    emitted then. Users are deduplicated per day in the state store, which forgets closed days.
    """
    return (
        acts.select("user_id", F.to_date("time").cast("timestamp").alias("day"))
        # The watermark is on the start of the day, so one more day brings it to the end.
        .withWatermark("day", f"{late_days + 1} days")
        .dropDuplicates(["day", "user_id"])
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("active_users"))
        .select(F.to_date("day").cast("string").alias("day"), "active_users")
    )


def stream_daily_active(acts: DataFrame, path: str, late_days: int = 1) -> StreamingQuery:
    """Append every closed day to the Parquet table `<path>/days`."""
    return (
        daily_active_stream(acts, late_days)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/days")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
