"""Leaderboard and people search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import default_photo, level, score_bar_text, score_bars
from ..operators import aggregates
from ..operators.joins import active_follow_edges
from ..operators.predicates import search_users
from ..sources.tables import SocialTables
from .marts import Marts


def _placed(page: DataFrame, order: list[Column]) -> DataFrame:
    """A page of people with each one's place on it. Spark knows the size of a limited page and broadcasts it if small."""
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def _people_rows(t: SocialTables, people: DataFrame, viewer_id: int) -> DataFrame:
    """Display rows of at most a page of people, with the viewer's follow value."""
    mine = t.follows.filter(F.col("user_id") == viewer_id)
    followed = active_follow_edges(mine).select(F.col("following").alias("id"), F.lit(1).alias("follow_value"))
    score = F.coalesce("user_score", F.lit(0))
    return people.join(followed, "id", "left").select(
        "id",
        "first_name",
        "handle",
        default_photo(F.col("profile_photo")).alias("profile_photo"),
        "creation_time",
        score.alias("user_score"),
        level(score).alias("user_level"),
        score_bars(score).alias("user_score_bars"),
        score_bar_text(score_bars(score)).alias("user_score_bars_print"),
        F.coalesce("follow_value", F.lit(0)).alias("follow_value"),
        "is_top_user",
        "place",
    )


def leaderboard(t: SocialTables, k: int = 100, viewer_id: int = 0, marts: Marts | None = None) -> DataFrame:
    """The k users with the highest score. Everything else is joined to those k rows."""
    marts = marts or Marts.from_tables(t)
    order = aggregates.by_score()
    best = _placed(marts.authors.withColumnRenamed("user_id", "id").orderBy(*order).limit(k), order)
    people = t.users.select("id", "creation_time").join(best, "id")
    return _people_rows(t, people, viewer_id).orderBy("place")


def people_search(
    t: SocialTables, term: str, k: int = 50, viewer_id: int = 0, marts: Marts | None = None
) -> DataFrame:
    """The k oldest accounts matching the term, with score and the viewer's follow value."""
    marts = marts or Marts.from_tables(t)
    found = search_users(t.users, term, k).select("id", "creation_time")
    found = _placed(found, [F.col("creation_time"), F.col("id")])
    people = marts.authors.withColumnRenamed("user_id", "id").join(found, "id")
    return _people_rows(t, people, viewer_id).orderBy("place")
