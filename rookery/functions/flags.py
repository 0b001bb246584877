"""Flags a page needs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def voted_up(vote: Column) -> Column:
    return F.coalesce(vote, F.lit(0)) >= 1


def voted_down(vote: Column) -> Column:
    return F.coalesce(vote, F.lit(0)) <= -1


def is_own(author_id: Column, viewer_id: Column) -> Column:
    return F.coalesce(author_id == viewer_id, F.lit(False))
