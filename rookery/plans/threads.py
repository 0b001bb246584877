"""Post pages: one post with its figures, and its thread of replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import net_votes
from ..operators.predicates import live, live_replies
from ..sources.tables import SocialTables
from .marts import Marts, post_cards

_COUNTS = ["reply_count", "up_votes", "down_votes", "user_score"]


def post_detail(
    t: SocialTables, viewer_id: int = 0, marts: Marts | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Every live post, or those of `ids` (post_id), with author, scores, counts and the viewer's vote."""
    posts, finders = t.text_refs()
    facts, texts = live(t.post_facts), live(posts).select("post_id", *finders)
    if ids is not None:
        wanted = ids.select("post_id")
        facts, texts = facts.join(wanted, "post_id", "left_semi"), texts.join(wanted, "post_id", "left_semi")
    cards = post_cards(t, marts or Marts.from_tables(t), facts, viewer_id, all_posts=ids is None)
    # The text joins last, so that it is shuffled once, or not at all where it is found later.
    return t.add_text(net_votes(cards).drop("post_score").fillna(0, _COUNTS).join(texts, "post_id"))


def thread_members(posts: DataFrame, depth: int = 2, heads: DataFrame | None = None) -> DataFrame:
    """(thread_id, level, parent_id, post_id) for the page of every live post, or those of `heads`.

    Level 0 is the post itself, level 1 its live replies, and so on. A post has at most one
    parent, so a post is in at most depth + 1 threads. Replies below a deleted post are in none.
    """
    first = live(posts).select("post_id")
    if heads is not None:
        first = first.join(heads.select("post_id"), "post_id", "left_semi")
    level = first.select(
        F.col("post_id").alias("thread_id"),
        F.lit(0).alias("level"),
        F.lit(None).cast("bigint").alias("parent_id"),
        "post_id",
    )
    members = level
    replies = live_replies(posts).select("post_id", F.col("reply_to_id").alias("parent_id"))
    for number in range(1, depth + 1):
        above = level.select("thread_id", F.col("post_id").alias("parent_id"))
        level = replies.join(above, "parent_id").select(
            "thread_id", F.lit(number).alias("level"), "parent_id", "post_id"
        )
        members = members.unionByName(level)
    return members


def thread(
    t: SocialTables,
    depth: int = 2,
    viewer_id: int = 0,
    marts: Marts | None = None,
    heads: DataFrame | None = None,
    detail: DataFrame | None = None,
) -> DataFrame:
    """The page of every live post, or those of `heads` (post_id): the post and `depth` levels
    of replies with their figures.

    A post shows on up to depth + 1 pages; `detail` is `post_detail` where the caller has
    formatted it once per post.
    """
    members = thread_members(t.post_facts, depth, heads)
    if detail is None:
        detail = post_detail(t, viewer_id, marts, ids=None if heads is None else members)
    return members.join(detail, "post_id")


def in_page_order(pages: DataFrame) -> DataFrame:
    """One or a few threads as shown: level by level, net votes first. The range sort is on the whole
    order, so a long thread is split over many tasks. All threads at once need no order among them."""
    return pages.orderBy("thread_id", "level", F.col("net_votes").desc(), "post_id")
