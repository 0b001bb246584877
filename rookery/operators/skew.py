"""Salted joins: a key that holds a large share of one side is spread over many tasks.

Adaptive execution splits a hot partition only where both join inputs are plain shuffles.
It cannot when one input is the output of an aggregation or join on the same key, or when
the next step reuses the join's partitioning; those joins salt their hot keys here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"
SALTS = "_salts"

# Rows of one key that one task takes, whatever the total; a key with more is hot.
ROWS_PER_SALT = 1_000_000
# Rows without a key match nothing and are dealt out over so many tasks.
NULL_SALTS = 1024


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, salts): keys with more rows than one task takes, and how many salts they are spread over."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > ROWS_PER_SALT).select(
        F.col(key), F.ceil(F.col("_n") / F.lit(ROWS_PER_SALT)).cast("int").alias(SALTS)
    )


def _with_salts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    # The list has at most a millionth of the rows; Spark broadcasts it where it finds it small.
    known = hot.toDF("_hot_key", SALTS)
    return df.join(known, df[key] == F.col("_hot_key"), "left").drop("_hot_key")


def one_salt(df: DataFrame, key: str, hot: DataFrame, spread_by: str) -> DataFrame:
    """Give every row one salt of its key, chosen by the hash of `spread_by`.

    The choice is repeatable, so a task that is run again sends rows to the same place.
    Rows without a key match nothing and are spread as well.
    """
    salts = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce(SALTS, F.lit(1)))
    return (
        _with_salts(df, key, hot)
        .withColumn(SALT, F.pmod(F.hash(spread_by), salts))
        .drop(SALTS)
    )


def every_salt(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Repeat every row once per salt of its key."""
    last = F.coalesce(SALTS, F.lit(1)) - 1
    return (
        _with_salts(df, key, hot)
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), last)))
        .drop(SALTS)
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread_by: str,
    how: str = "left",
    counted: DataFrame | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join on `key` where few rows per key on the right meet many on the left.

    `counted` is a frame with the left side's keys that is cheaper to count than `left`;
    `hot` is the result of `hot_keys` where the caller has it, as `Marts` stores it.
    """
    if hot is None:
        hot = hot_keys(left if counted is None else counted, key)
    spread = one_salt(left, key, hot, spread_by)
    return spread.join(every_salt(right, key, hot), [key, SALT], how).drop(SALT)
