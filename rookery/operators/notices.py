"""Notifications caused by follows, replies and mentions.

Each function also accepts a stream as its first argument: only stateless steps and
joins with static tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import extract_mentions
from ..functions.text import FOLLOW, MENTIONED, REPLY
from .joins import ids_by_handle

NOTICE_COLUMNS = ("user_id", "triggered_by_user_id", "event_type_id", "reference_post_id", "creation_time")


def follow_notifications(events: DataFrame) -> DataFrame:
    """Tell the followed user about every follow, but not about unfollows and self-follows."""
    started = events.filter((F.col("follow_value") > 0) & (F.col("user_id") != F.col("following")))
    return started.select(
        F.col("following").alias("user_id"),
        F.col("user_id").alias("triggered_by_user_id"),
        F.lit(FOLLOW).alias("event_type_id"),
        F.lit(None).cast("bigint").alias("reference_post_id"),
        "creation_time",
    )


def reply_notifications(new_posts: DataFrame, posts: DataFrame) -> DataFrame:
    """Tell the author of the answered post, unless they answered themself; refers to that post."""
    parents = posts.select(F.col("post_id").alias("reply_to_id"), F.col("user_id").alias("_author"))
    answered = new_posts.filter(F.col("reply_to_id").isNotNull()).select(
        "reply_to_id", "user_id", "creation_time"
    )
    return (
        answered.join(parents, "reply_to_id")
        .filter(F.col("_author") != F.col("user_id"))
        .select(
            F.col("_author").alias("user_id"),
            F.col("user_id").alias("triggered_by_user_id"),
            F.lit(REPLY).alias("event_type_id"),
            F.col("reply_to_id").alias("reference_post_id"),
            "creation_time",
        )
    )


def mention_notifications(new_posts: DataFrame, users: DataFrame) -> DataFrame:
    """Tell every known user named with @handle, once per mention; refers to the new post."""
    return notify_mentioned(new_posts.filter(F.col("post_text").contains("@")).withColumn("names", extract_mentions(F.col("post_text"))), users)


def notify_mentioned(new_posts: DataFrame, users: DataFrame) -> DataFrame:
    """`mention_notifications` of posts whose `names` are those they mention."""
    known = ids_by_handle(users, "_mentioned")
    named = new_posts.select("post_id", "user_id", "creation_time", F.explode("names").alias("_name")).withColumn("_handle", F.lower("_name"))
    return named.join(known, "_handle").select(
        F.col("_mentioned").alias("user_id"),
        F.col("user_id").alias("triggered_by_user_id"),
        F.lit(MENTIONED).alias("event_type_id"),
        F.col("post_id").alias("reference_post_id"),
        "creation_time",
    )
