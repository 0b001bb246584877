"""Enriching joins. Every right side has one row per key unless the docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import top_k
from .skew import spread_join

AUTHOR_COLUMNS = ("first_name", "handle", "profile_photo")


def with_author(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Name, handle and photo of the author."""
    author = users.select(F.col("id").alias("user_id"), *AUTHOR_COLUMNS)
    return posts.join(author, "user_id", "left")


def with_scores(
    posts: DataFrame, post_scores: DataFrame, user_scores: DataFrame, votes_of_viewer: DataFrame | None = None
) -> DataFrame:
    """Post score, author score and, given (post_id, current_user_vote), the viewer's vote."""
    authors = user_scores.select(F.col("id").alias("user_id"), "user_score")
    out = spread_join(
        posts.join(post_scores, "post_id", "left"), authors, "user_id", "post_id", counted=posts
    )
    if votes_of_viewer is None:
        return out.withColumn("current_user_vote", F.lit(0).cast("bigint"))
    vote = votes_of_viewer.select("post_id", "current_user_vote")
    return out.join(vote, "post_id", "left").fillna(0, ["current_user_vote"])


def with_post_stats(df: DataFrame, *stats: DataFrame) -> DataFrame:
    """Add counts keyed by post_id; a post without any keeps NULL."""
    for counts in stats:
        df = df.join(counts, "post_id", "left")
    return df


def active_follow_edges(follows: DataFrame) -> DataFrame:
    """Distinct (user_id, following) pairs that are in force; repeated rows collapse."""
    return follows.filter(F.col("follow_value") == 1).select("user_id", "following").distinct()


def follow_status(follows: DataFrame, pairs: DataFrame) -> DataFrame:
    """0 or 1 for every (viewer_id, user_id) pair."""
    edges = active_follow_edges(follows).select(
        F.col("user_id").alias("viewer_id"),
        F.col("following").alias("user_id"),
        F.lit(1).alias("follow_status"),
    )
    return pairs.join(edges, ["viewer_id", "user_id"], "left").fillna(0, ["follow_status"])


def votes_by_camp(posts: DataFrame, votes: DataFrame) -> DataFrame:
    """Posts with the sum of the votes that carry the post's own camp."""
    scores = votes.groupBy("camp_id", "post_id").agg(
        F.sum("value").cast("bigint").alias("post_score")
    )
    return posts.join(scores, ["camp_id", "post_id"], "left")


def with_media(posts: DataFrame, media: DataFrame) -> DataFrame:
    """Photos of a post; one row per photo, or one without a photo.

    Posts without media, most of them, do not take part in the join.
    """
    photos = media.select("media_id", "photo_url")
    with_photo = posts.filter(F.col("media_id").isNotNull()).join(photos, "media_id", "left")
    return with_photo.unionByName(posts.filter(F.col("media_id").isNull()), allowMissingColumns=True)


def camp_members_with_score(
    directory: DataFrame, users: DataFrame, user_scores: DataFrame, camp_id: int
) -> DataFrame:
    """Members of a camp with handle and score."""
    members = directory.filter(F.col("camp_id") == camp_id)
    people = users.select("id", "handle").join(user_scores, "id", "left")
    return members.join(people.withColumnRenamed("id", "user_id"), "user_id", "left")


def last_vote(votes: DataFrame, down_only: bool = True) -> DataFrame:
    """The latest (down) vote of every user on every post."""
    if down_only:
        votes = votes.filter(F.col("value") < 0)
    order = [F.col("added_time").desc(), F.col("value").desc()]
    return top_k(votes, ["post_id", "user_id"], order, 1).select(
        "post_id", "user_id", F.col("added_time").alias("last_vote"), "value"
    )


def with_actor(notifications: DataFrame, users: DataFrame) -> DataFrame:
    """Photo and handle of the user who caused the notification."""
    actor = users.select(F.col("id").alias("triggered_by_user_id"), "profile_photo", "handle")
    return notifications.join(actor, "triggered_by_user_id", "left")


def ids_by_handle(users: DataFrame, out: str = "id") -> DataFrame:
    """(_handle, id): the one user a handle stands for, ignoring case; the lowest id where several share it."""
    return users.groupBy(F.lower("handle").alias("_handle")).agg(F.min("id").alias(out))


def resolve_handles(events: DataFrame, users: DataFrame, out: str = "following") -> DataFrame:
    """Turn the `handle` of an event into a user id, ignoring case; unknown handles drop out."""
    known = ids_by_handle(users, out)
    named = events.withColumn("_handle", F.lower("handle")).drop("handle")
    return named.join(known, "_handle").drop("_handle")
