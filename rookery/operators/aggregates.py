"""Aggregations over votes, posts and notifications.

Sums stay NULL where nothing was voted, because ranking puts such users last;
the display functions turn NULL into 0.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import default_photo, level, score_bar_text, score_bars
from .predicates import live, quarter_window
from .ranking import top_k


def _votes_total(column: str = "value") -> Column:
    return F.sum(column).cast("bigint")


def latest_post_id(posts: DataFrame, by_user: bool = False) -> DataFrame:
    """Greatest post id (0 without posts) and the default paging cursor above it."""
    newest = F.coalesce(F.max("post_id"), F.lit(0)).alias("latest_post_id")
    found = posts.groupBy("user_id").agg(newest) if by_user else posts.agg(newest)
    return found.withColumn("cursor", F.col("latest_post_id") + 1)


def post_score(votes: DataFrame) -> DataFrame:
    return votes.groupBy("post_id").agg(_votes_total().alias("post_score"))


def vote_counts(votes: DataFrame) -> DataFrame:
    """Up and down votes per post; zeros count as neither."""
    return votes.groupBy("post_id").agg(
        F.count_if(F.col("value") > 0).alias("up_votes"),
        F.count_if(F.col("value") < 0).alias("down_votes"),
    )


def post_stats(votes: DataFrame) -> DataFrame:
    """`post_score` and `vote_counts` in one pass."""
    return votes.groupBy("post_id").agg(
        _votes_total().alias("post_score"),
        F.count_if(F.col("value") > 0).alias("up_votes"),
        F.count_if(F.col("value") < 0).alias("down_votes"),
    )


def net_votes(stats: DataFrame) -> DataFrame:
    """Up minus down, missing counts as 0."""
    zero = F.lit(0)
    return stats.withColumn(
        "net_votes",
        (F.coalesce("up_votes", zero) - F.coalesce("down_votes", zero)).cast("bigint"),
    )


def viewer_vote(votes: DataFrame, camp_id: int | None = None) -> DataFrame:
    """Sum of a user's votes per post, of one camp if given."""
    if camp_id is not None:
        votes = votes.filter(F.col("camp_id") == camp_id)
    return votes.groupBy(F.col("user_id").alias("viewer_id"), "post_id").agg(
        _votes_total().alias("current_user_vote")
    )


def reply_count(posts: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Replies per post, without the deleted ones unless asked for."""
    return (
        (posts if include_deleted else live(posts))
        .filter(F.col("reply_to_id").isNotNull())
        .groupBy(F.col("reply_to_id").alias("post_id"))
        .agg(F.count(F.lit(1)).alias("reply_count"))
    )


def author_score(posts: DataFrame, votes: DataFrame) -> DataFrame:
    """Score of every author with votes: all their posts count, replies and deleted ones too.

    Votes are summed by post before the join, so a post with many votes joins as one row.
    """
    return author_score_of(posts, post_score(votes))


def author_score_of(posts: DataFrame, scores: DataFrame) -> DataFrame:
    """Score of every author, given one row with `post_score` per voted post."""
    voted = posts.select("post_id", "user_id").join(scores.select("post_id", "post_score"), "post_id")
    return voted.groupBy("user_id").agg(_votes_total("post_score").alias("user_score"))


def user_score(users: DataFrame, posts: DataFrame, votes: DataFrame) -> DataFrame:
    """Score of every user, NULL without votes."""
    scores = author_score(posts, votes).withColumnRenamed("user_id", "id")
    return users.select("id").join(scores, "id", "left")


def by_score() -> list[Column]:
    """Highest score first, users without votes last, lower id first among equals."""
    return [F.col("user_score").desc_nulls_last(), F.col("id").asc()]


def top_user(user_scores: DataFrame) -> DataFrame:
    """The one user with the highest score."""
    return user_scores.orderBy(*by_score()).limit(1)


def author_scores_by_name(
    users: DataFrame, posts: DataFrame, votes: DataFrame, name: str = "username"
) -> DataFrame:
    """Score per name; users who share a name share one score."""
    return scores_by_name(users, author_score(posts, votes).withColumnRenamed("user_id", "id"), name)


def scores_by_name(users: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """Summed scores per name, given (id, user_score)."""
    named = users.select("id", name).join(scores, "id", "left")
    return named.groupBy(name).agg(_votes_total("user_score").alias("user_score"))


def activity(votes: DataFrame, posts: DataFrame) -> DataFrame:
    """Who acted when: every vote and every post."""
    voted = votes.select("user_id", F.col("added_time").alias("time"))
    posted = posts.select("user_id", F.col("creation_time").alias("time"))
    return voted.unionByName(posted)


def daily_active_users(
    votes: DataFrame, posts: DataFrame, as_of: dt.date, approximate: bool = False
) -> DataFrame:
    """Distinct users who voted or posted, per UTC day of the quarter of `as_of`."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    acts = quarter_window(activity(votes, posts), as_of, "time")
    return (
        acts.groupBy(F.to_date("time").alias("day"))
        .agg(distinct(F.col("user_id")).alias("active_users"))
        .orderBy("day")
    )


def profile_summary(users: DataFrame, user_scores: DataFrame) -> DataFrame:
    """Profile header of every user: names, photo, bio, level and bars."""
    score = F.coalesce("user_score", F.lit(0))
    return users.join(user_scores, "id", "left").select(
        "id",
        "handle",
        "first_name",
        default_photo(F.col("profile_photo")).alias("profile_photo"),
        F.coalesce("bio", F.lit("")).alias("bio"),
        score.alias("user_score"),
        level(score).alias("user_level"),
        score_bars(score).alias("user_score_bars"),
        score_bar_text(score_bars(score)).alias("user_score_bars_print"),
    )


_NEWEST_NOTICE = ("creation_time", "notification_id")


def newest_notifications(notifications: DataFrame, k: int) -> DataFrame:
    """Each user's k newest notifications."""
    return top_k(notifications, ["user_id"], [F.col(c).desc() for c in _NEWEST_NOTICE], k)


def latest_notifications(notifications: DataFrame, k: int = 25) -> DataFrame:
    """The k newest notifications of all users."""
    return notifications.orderBy(*[F.col(c).desc() for c in _NEWEST_NOTICE]).limit(k)


def unseen_count(notifications: DataFrame, k: int | None = 25) -> DataFrame:
    """Unseen rows among each user's k newest; `k=None` counts all of them."""
    shown = notifications if k is None else newest_notifications(notifications, k)
    return shown.groupBy("user_id").agg(F.count_if(F.col("seen") == 0).alias("unseen_count"))
