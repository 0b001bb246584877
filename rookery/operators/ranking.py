"""Top-k and latest-row helpers.

`row_number() <= k` plans as WindowGroupLimit below the shuffle, so a hot group sends at most
k rows per input partition to the task that ranks it. Spark does so up to
`spark.sql.optimizer.windowGroupLimitThreshold` rows, 1000 unless it is set; `build_session` lifts it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, page: int = 1, place: str | None = None
) -> DataFrame:
    """The first k rows of every group of `by` in `order`, or the k rows of a later page.

    `place` names a column for the row's place in its group, from 1.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    shown = df.withColumn(_RANK, rank).filter(F.col(_RANK) <= k * page)
    if page > 1:
        shown = shown.filter(F.col(_RANK) > k * (page - 1))
    return shown.withColumnRenamed(_RANK, place) if place else shown.drop(_RANK)


def latest_by_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest `newest` columns."""
    return top_k(df, keys, [F.col(c).desc() for c in newest], 1)
