"""Text expressions: post shortening, mentions, notification wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the display and of the notification types.
MENTION = "@([a-zA-Z0-9_]+)"
MENTION_LINK = '<a href="/@$1">@$1</a>'
NO_PHOTO = "no_image.jpg"
SOFT_LIMIT = 400
HARD_LIMIT = 450
FOLLOW, REPLY, MENTIONED = 1, 2, 3
NOTICE_WORDING = {FOLLOW: "now follows you", REPLY: "replied to your post", MENTIONED: "mentioned you"}


def is_long_post(text: Column) -> Column:
    return F.length(text) > SOFT_LIMIT


def truncate_post(text: Column) -> Column:
    """Long posts end at the first space after 400 characters, or at 450, plus `...`."""
    tail = F.substring(text, SOFT_LIMIT + 1, HARD_LIMIT - SOFT_LIMIT)
    space = F.instr(tail, " ")
    cut = F.when(space > 0, F.lit(SOFT_LIMIT - 1) + space).otherwise(
        F.least(F.lit(HARD_LIMIT), F.length(text))
    )
    return F.when(
        is_long_post(text), F.concat(F.substr(text, F.lit(1), cut), F.lit("..."))
    ).otherwise(text)


def extract_mentions(text: Column) -> Column:
    """All handles written as @handle, in order, repeats kept.

    Most posts mention nobody; looking for the sign first is much cheaper than matching.
    """
    found = F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))
    return F.when(text.contains("@"), found).otherwise(F.array().cast("array<string>"))


def linkify(text: Column) -> Column:
    """Every @handle becomes a link to its profile."""
    return F.when(text.contains("@"), F.regexp_replace(text, MENTION, MENTION_LINK)).otherwise(text)


def default_photo(photo: Column) -> Column:
    return F.coalesce(F.nullif(photo, F.lit("")), F.lit(NO_PHOTO))


def notification_text(event_type: Column) -> Column:
    """Wording by type; unknown types have none."""
    wording = F.lit("")
    for code, words in NOTICE_WORDING.items():
        wording = F.when(event_type == code, F.lit(words)).otherwise(wording)
    return wording


def notification_link(event_type: Column, handle: Column, post_id: Column) -> Column:
    """Profile of the follower, or the referenced post (0 when there is none)."""
    post = F.coalesce(post_id, F.lit(0)).cast("string")
    return (
        F.when(event_type == FOLLOW, F.concat(F.lit("/@"), F.coalesce(handle, F.lit(""))))
        .when(event_type.isin(REPLY, MENTIONED), F.concat(F.lit("/post/"), post))
        .otherwise(F.lit(""))
    )
