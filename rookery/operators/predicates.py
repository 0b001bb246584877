"""Filters, windows of time, paging and people search."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ntz
from ..functions.times import LOCAL_OFFSET_HOURS
from .prefilter import restrict_by_bitmap
from .ranking import top_k
from .skew import spread_join


def live(posts: DataFrame) -> DataFrame:
    return posts.filter(F.col("is_deleted") == 0)


def root_posts(posts: DataFrame) -> DataFrame:
    """Posts that answer no other post and are not deleted."""
    return live(posts).filter(F.col("reply_to_id").isNull())


def live_replies(posts: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Replies that are not deleted; with `parents` only replies to those posts."""
    replies = live(posts).filter(F.col("reply_to_id").isNotNull())
    if parents is None:
        return replies
    ids = parents.select(F.col("post_id").alias("reply_to_id"))
    return replies.join(ids, "reply_to_id", "left_semi")


def posts_in_camp(posts: DataFrame, camp_id: int) -> DataFrame:
    return posts.filter(F.col("camp_id") == camp_id)


def restrict_ids(df: DataFrame, ids: DataFrame, column: str, spread_by: str, bitmap: bool = False) -> DataFrame:
    """Rows whose `column` occurs in the same column of `ids`; the ids never leave the executors.

    `spread_by` tells apart rows that share an id, for ids that very many rows share. With `bitmap` the ids are counted
    first, and where a bitmap of them can be broadcast, most rows without a partner are dropped before any shuffle: worth it for a list
    too long to be broadcast itself that leaves out most rows.
    """
    if bitmap:
        df = restrict_by_bitmap(df, ids, column)
    return spread_join(df, ids.select(column).distinct(), column, spread_by, "left_semi")


def keyset_page(
    posts: DataFrame, n: int, cursor: int | DataFrame | None = None, by: str | None = None
) -> DataFrame:
    """The newest n posts below the cursor, over all posts or for every value of `by`.

    A frame of cursors, as `next_cursor` gives it, has the columns `by` and `cursor`; groups
    without one start at the top.
    """
    if isinstance(cursor, DataFrame) and by is None:
        posts = posts.filter(F.col("post_id") < cursor.select("cursor").scalar())
    elif isinstance(cursor, DataFrame):
        posts = (
            spread_join(posts, cursor.select(by, "cursor"), by, "post_id")
            .filter(F.col("cursor").isNull() | (F.col("post_id") < F.col("cursor")))
            .drop("cursor")
        )
    elif cursor is not None:
        posts = posts.filter(F.col("post_id") < cursor)
    newest = F.col("post_id").desc()
    if by is None:
        return posts.orderBy(newest).limit(n)
    return top_k(posts, [by], [newest], n)


def next_cursor(page: DataFrame, by: str | None = None) -> DataFrame:
    """Where the following page starts: the smallest post id shown."""
    lowest = F.min("post_id").alias("cursor")
    return page.groupBy(by).agg(lowest) if by else page.agg(lowest)


def day_window(
    posts: DataFrame, day: dt.date, column: str = "creation_time", offset: int = LOCAL_OFFSET_HOURS
) -> DataFrame:
    """Rows of one local day. Both midnights are inside, so a row at exactly midnight is in two days.

    The offset is moved to the bounds to leave a plain range that Parquet can skip by.
    """
    start = dt.datetime.combine(day, dt.time()) + dt.timedelta(hours=offset)
    end = start + dt.timedelta(days=1)
    shown = posts.filter(F.col(column).between(ntz(start), ntz(end)))
    if "local_month" in posts.columns and column == "creation_time" and offset == LOCAL_OFFSET_HOURS:
        # Saved posts are partitioned by it; the next midnight can be in the next month.
        months = sorted({d.strftime("%Y-%m") for d in (day, day + dt.timedelta(days=1))})
        shown = shown.filter(F.col("local_month").isin(months))
    return shown


def quarter_bounds(as_of: dt.date) -> tuple[dt.datetime, dt.datetime]:
    """First moment of the quarter of `as_of` and of the next one."""
    month = 3 * ((as_of.month - 1) // 3) + 1
    start = dt.datetime(as_of.year, month, 1)
    end = dt.datetime(as_of.year + month // 10, (month + 2) % 12 + 1, 1)
    return start, end


def quarter_window(df: DataFrame, as_of: dt.date, column: str) -> DataFrame:
    """Rows within the quarter of `as_of`, end excluded."""
    start, end = quarter_bounds(as_of)
    return df.filter((F.col(column) >= ntz(start)) & (F.col(column) < ntz(end)))


def _matches(term: str) -> Column:
    # A backslash before an ordinary character stands for that character.
    pattern = "%" + re.sub(r"(\\[%_\\])|\\(.)", r"\1\2", term) + "%"
    return F.col("handle").ilike(pattern) | F.col("first_name").ilike(pattern)


_OLDEST = ("creation_time", "id")


def search_users(users: DataFrame, term: str, k: int = 50) -> DataFrame:
    """Users whose handle or first name contains the term, oldest account first.

    Case does not matter, and `%` and `_` in the term act as wildcards.
    """
    return users.filter(_matches(term)).orderBy(*_OLDEST).limit(k)


def search_users_many(users: DataFrame, terms: Sequence[str], k: int = 50) -> DataFrame:
    """`search_users` for several terms in one scan; column `term` tells which one matched."""
    hits = F.array_compact(F.array(*[F.when(_matches(t), F.lit(t)) for t in dict.fromkeys(terms)]))
    found = users.withColumn("term", F.explode(hits))
    return top_k(found, ["term"], [F.col(c).asc() for c in _OLDEST], k)


def user_by_handle(users: DataFrame, handle: str) -> DataFrame:
    """The users of a handle, ignoring case; saved users have it in lower case, which the scan filters by."""
    name = F.col("handle_lower") if "handle_lower" in users.columns else F.lower("handle")
    return users.filter(name == handle.lower())
