"""Appending event rows and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_GRAIN_FORMAT = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def append_events(df: DataFrame, path: str, time_col: str, grain: str = "day") -> None:
    """Append rows to a table partitioned by the day (or month, year) of `time_col`.

    The rebalance hint lets adaptive execution merge small output partitions and
    split large ones, so a hot day is written by several tasks.
    """
    name = f"event_{grain}"
    stamped = df.withColumn(name, F.date_format(F.to_date(time_col), _GRAIN_FORMAT[grain]))
    stamped.hint("rebalance", name).write.mode("append").partitionBy(name).parquet(path)


def export_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in column `json`."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    export_json(df).write.mode("errorifexists").text(path)
