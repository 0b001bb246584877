"""Score display: levels, bars and count labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the display.
POINTS_PER_LEVEL = 10
FULL_BAR = "⬛"
EMPTY_BAR = "⬜"


def level(score: Column) -> Column:
    """Whole tens of the score, cut toward zero; NULL counts as 0."""
    return (F.coalesce(score, F.lit(0)) / POINTS_PER_LEVEL).cast("bigint")


def score_bars(score: Column) -> Column:
    """Points within the level, 0 to 9. Negative scores wrap: -3 has 7 bars."""
    return F.pmod(F.coalesce(score, F.lit(0)), F.lit(POINTS_PER_LEVEL)).cast("bigint")


def score_bar_text(bars: Column) -> Column:
    """`bars` full squares followed by empty ones, ten in all."""
    filled = bars.cast("int")
    return F.concat(
        F.repeat(F.lit(FULL_BAR), filled),
        F.repeat(F.lit(EMPTY_BAR), F.lit(POINTS_PER_LEVEL) - filled),
    )


def blank_zero(count: Column) -> Column:
    """The count as text, with a single space for 0 and NULL."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(" ")).otherwise(count.cast("string"))
