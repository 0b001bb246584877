"""Change jobs: a snapshot and a batch of events give the next snapshot.

Results are new frames to be written to a new folder; no job writes where it reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import latest_by_key
from .skew import spread_join

VOTE_KEY = ("camp_id", "user_id", "post_id")
FOLLOW_KEY = ("user_id", "following")
VOTE_RULES = ("exact", "sign")


def normalise_votes(events: DataFrame, rule: str = "exact") -> DataFrame:
    """Turn `raw_value` into a vote `value`.

    `exact` keeps 1 and -1 and makes anything else 0; `sign` gives 1 from 0 upward, else -1.
    """
    raw = F.col("raw_value")
    if rule == "exact":
        value = F.when(raw == 1, 1).when(raw == -1, -1).otherwise(0)
    elif rule == "sign":
        value = F.when(raw >= 0, 1).otherwise(-1)
    else:
        raise ValueError(f"unknown vote rule {rule!r}, use one of {VOTE_RULES}")
    return events.withColumn("value", value)


def reject_self_votes(events: DataFrame, posts: DataFrame) -> DataFrame:
    """Drop votes on the voter's own post."""
    return events.join(posts.select("post_id", "user_id"), ["post_id", "user_id"], "left_anti")


def merge_latest(
    snapshot: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    time_col: str,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Upsert by key: the newest event replaces the stored row unless that is newer.

    Columns of the snapshot that events do not carry, such as row ids, keep their stored value
    and are NULL in new rows. Events are cut to one row per key first. Stored rows are then
    updated by a left join, which needs no shuffle of the snapshot while the batch is small
    enough to broadcast; the second, key-only pass over the snapshot finds the new rows.
    """
    types = {f.name: f.dataType for f in snapshot.schema}
    carried = [c for c in snapshot.columns if c in events.columns]
    newest = latest_by_key(events, keys, [time_col, *tie_break])
    newest = newest.select(*[F.col(c).cast(types[c]) for c in carried])
    values = [c for c in carried if c not in keys]
    incoming = newest.select(*keys, F.struct(*values).alias("_new"))
    stored = snapshot.join(incoming, list(keys), "left")
    replace_row = F.col(f"_new.{time_col}") >= F.coalesce(time_col, f"_new.{time_col}")
    updated = stored.select(
        *[
            F.when(replace_row, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in snapshot.columns
        ]
    )
    known = snapshot.select(*keys).join(incoming.select(*keys), list(keys), "left_semi")
    # From `incoming`, not `newest`: the same columns let both joins read one shuffle of the batch.
    inserted = incoming.join(known, list(keys), "left_anti").select(*keys, "_new.*")
    return updated.unionByName(inserted, allowMissingColumns=True)


def apply_votes(snapshot: DataFrame, events: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """One current row per (camp, user, post). A vote of 0 stays as a row."""
    return merge_latest(snapshot, events, VOTE_KEY, "added_time", tie_break)


def clean_follow_events(events: DataFrame) -> DataFrame:
    """Clamp the value to 0 or 1 and drop self-follows."""
    clamped = F.when(F.col("follow_value") > 0, 1).otherwise(0)
    return events.filter(F.col("user_id") != F.col("following")).withColumn("follow_value", clamped)


def apply_follows(snapshot: DataFrame, events: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """One current edge per (user, following)."""
    return merge_latest(snapshot, clean_follow_events(events), FOLLOW_KEY, "creation_time", tie_break)


def apply_post_deletes(posts: DataFrame, requests: DataFrame) -> DataFrame:
    """Mark a post as deleted when its owner asked for it."""
    asked = requests.select("post_id", "user_id").distinct().withColumn("_asked", F.lit(1))
    deleted = F.when(F.col("_asked") == 1, 1).otherwise(F.col("is_deleted"))
    return (
        posts.join(asked, ["post_id", "user_id"], "left")
        .withColumn("is_deleted", deleted)
        .select(*posts.columns)
    )


def mark_notifications_seen(notifications: DataFrame, requests: DataFrame) -> DataFrame:
    """Mark what a user had not seen before their latest request (user_id, seen_time) of the batch.

    Notifications created after that request stay unseen.
    """
    latest = requests.groupBy("user_id").agg(F.max("seen_time").alias("_seen_time"))
    joined = spread_join(notifications, latest, "user_id", "notification_id")
    if "seen_time" not in notifications.columns:
        joined = joined.withColumn("seen_time", F.lit(None).cast("timestamp_ntz"))
    hit = (F.col("seen") == 0) & (F.col("creation_time") <= F.col("_seen_time"))
    return joined.select(
        *[c for c in notifications.columns if c not in ("seen", "seen_time")],
        F.when(hit, 1).otherwise(F.col("seen")).alias("seen"),
        F.when(hit, F.col("_seen_time")).otherwise(F.col("seen_time")).alias("seen_time"),
    )


def apply_profile_edits(users: DataFrame, edits: DataFrame, tie_break: Sequence[str] = ()) -> DataFrame:
    """Latest name and bio per user; the latest photo among the edits that bring one."""
    order = F.struct("edit_time", *tie_break)
    photo = F.nullif(F.col("profile_photo"), F.lit(""))
    newest = edits.groupBy(F.col("user_id").alias("id")).agg(
        F.max_by(F.struct("first_name", "bio"), order).alias("_text"),
        F.max_by(photo, F.when(photo.isNotNull(), order)).alias("_photo"),
    )
    edited = F.col("_text").isNotNull()
    return (
        users.join(newest, "id", "left")
        .withColumn("first_name", F.when(edited, F.col("_text.first_name")).otherwise(F.col("first_name")))
        .withColumn("bio", F.when(edited, F.col("_text.bio")).otherwise(F.col("bio")))
        .withColumn("profile_photo", F.coalesce("_photo", "profile_photo"))
        .select(*users.columns)
    )


def consume_tokens(tokens: DataFrame, uses: DataFrame) -> DataFrame:
    """Mark redeemed tokens as used."""
    redeemed = uses.select("token").distinct().withColumn("_redeemed", F.lit(1))
    used = F.when(F.col("_redeemed") == 1, 1).otherwise(F.col("used"))
    return tokens.join(redeemed, "token", "left").withColumn("used", used).select(*tokens.columns)


def join_camp(directory: DataFrame, requests: DataFrame) -> DataFrame:
    """Add the (camp, user) pairs that are not members yet, with the time of the first request."""
    pair = ["camp_id", "user_id"]
    if "added_time" in directory.columns and "added_time" in requests.columns:
        asked = requests.groupBy(*pair).agg(F.min("added_time").alias("added_time"))
    else:
        asked = requests.select(*pair).distinct()
    fresh = asked.join(directory.select(*pair), pair, "left_anti")
    return directory.unionByName(fresh, allowMissingColumns=True)
