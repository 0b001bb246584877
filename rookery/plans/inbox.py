"""Notification inbox."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import default_photo, notification_link, notification_text, time_ago
from ..operators.aggregates import newest_notifications
from ..operators.joins import with_actor
from ..sources.tables import SocialTables


def notification_inbox(t: SocialTables, as_of: str | dt.datetime, k: int = 25) -> DataFrame:
    """The k newest notifications of every user with actor, wording, link and age."""
    rows = with_actor(newest_notifications(t.notifications, k), t.users)
    kind = F.col("event_type_id")
    return rows.select(
        "user_id",
        "notification_id",
        "creation_time",
        "event_type_id",
        F.coalesce("reference_post_id", F.lit(0)).alias("reference_post_id"),
        "seen",
        default_photo(F.col("profile_photo")).alias("profile_photo"),
        "handle",
        notification_text(kind).alias("text"),
        notification_link(kind, F.col("handle"), F.col("reference_post_id")).alias("redirect"),
        time_ago(F.col("creation_time"), as_of).alias("time_ago"),
    )
