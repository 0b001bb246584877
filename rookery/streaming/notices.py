"""New posts and follow events to notifications.

The tables joined against grow while the stream runs, so they are given as functions
and read afresh for every batch. A reply that arrives before the post it answers waits: it is written to a pending table and matched
again in every later batch, until its parent is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import extract_mentions
from ..operators.notices import follow_notifications, notify_mentioned, reply_notifications
from ..session import delete_folder, finished_versions

_REPLY = ("post_id", "reply_to_id", "user_id", "creation_time")


def _start(events: DataFrame, make: Callable[[DataFrame, int], DataFrame], path: str, name: str) -> StreamingQuery:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        notices = make(batch, batch_id).withColumn("seen", F.lit(0))
        notices.write.mode("overwrite").parquet(f"{path}/notices/source={name}/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{path}/checkpoint-{name}")
        .trigger(availableNow=True)
        .start()
    )


def pending_replies(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """Replies whose parent had not arrived by the last batch (before the batch `before`); None before any."""
    done = [b for b in finished_versions(spark, f"{path}/pending", "batch_id") if before is None or b < before]
    return spark.read.parquet(f"{path}/pending/batch_id={done[-1]}") if done else None


def _take_replies(batch: DataFrame, batch_id: int, posts: Callable[[], DataFrame], path: str, wait_days: int | None) -> DataFrame:
    """Notifications of the batch's replies and of the waiting ones whose parent is there now; the rest goes on waiting."""
    spark = batch.sparkSession
    replies = batch.filter(F.col("reply_to_id").isNotNull()).select(*_REPLY)
    waiting = pending_replies(spark, path, batch_id)
    if waiting is not None:
        replies = replies.unionByName(waiting)
    low, high, newest = replies.agg(F.min("reply_to_id"), F.max("reply_to_id"), F.max("creation_time")).first()
    # The table of posts may hold those of this batch already, or not yet.
    own = batch.select("post_id", "user_id")
    parents = posts().select("post_id", "user_id").filter(F.col("post_id").between(low, high)).unionByName(own).dropDuplicates(["post_id"])
    alone = replies.join(parents.select(F.col("post_id").alias("reply_to_id")), "reply_to_id", "left_anti").select(*_REPLY)
    if wait_days is not None and newest is not None:
        alone = alone.filter(F.col("creation_time") >= F.lit(newest) - F.make_dt_interval(F.lit(wait_days)))
    alone.write.mode("overwrite").parquet(f"{path}/pending/batch_id={batch_id}")
    for old in finished_versions(spark, f"{path}/pending", "batch_id"):
        if old < batch_id - 1:  # a repetition of this batch starts from the one before
            delete_folder(spark, f"{path}/pending/batch_id={old}")
    return reply_notifications(replies, parents)


def stream_post_notifications(
    new_posts: DataFrame,
    posts: Callable[[], DataFrame],
    users: Callable[[], DataFrame],
    path: str,
    wait_days: int | None = None,
) -> StreamingQuery:
    """Reply and mention notifications of all waiting posts.

    Each batch reads its texts once, to write down the names they mention; then the posts in the range of its parents' ids
    only, and users only if it mentions any. Replies
    wait for their parent for good, or until a reply `wait_days` newer has arrived.
    """

    def make(batch: DataFrame, batch_id: int) -> DataFrame:
        folder = f"{path}/read/batch_id={batch_id}"
        batch.select(*_REPLY, extract_mentions(F.col("post_text")).alias("names")).write.mode("overwrite").parquet(folder)
        for old in finished_versions(batch.sparkSession, f"{path}/read", "batch_id"):
            if old != batch_id:
                delete_folder(batch.sparkSession, f"{path}/read/batch_id={old}")
        read = batch.sparkSession.read.parquet(folder)
        mentions = read.agg(F.count_if(F.size("names") > 0)).first()[0]
        notices = _take_replies(read, batch_id, posts, path, wait_days)
        return notices.unionByName(notify_mentioned(read, users())) if mentions else notices

    return _start(new_posts, make, path, "posts")


def stream_follow_notifications(follow_events: DataFrame, path: str) -> StreamingQuery:
    """Follow notifications of all waiting follow events."""
    return _start(follow_events, lambda batch, _: follow_notifications(batch), path, "follows")


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/notices").drop("source", "batch_id")
