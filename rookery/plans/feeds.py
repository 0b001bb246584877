"""Home feed, profile feed, top of the day, and their display form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import (
    blank_zero,
    default_photo,
    display_date,
    display_day,
    is_long_post,
    level,
    local_day,
    score_bars,
    time_ago,
    truncate_post,
)
from ..functions.times import LOCAL_OFFSET_HOURS
from ..operators import aggregates, skew
from ..operators.joins import active_follow_edges
from ..operators.predicates import keyset_page, root_posts
from ..operators.ranking import top_k
from ..sources.tables import SocialTables
from .marts import Marts, post_cards


# Ids in a block of an author's posts, for feeds that start at each viewer's own cursor.
BLOCK = 64


def feed_edges(t: SocialTables) -> DataFrame:
    """(viewer_id, author_id): whose posts a viewer sees, their own included.

    Self rows come from users and follow rows never are self rows, so no distinct is needed
    beyond the one on the edges.
    """
    followed = active_follow_edges(t.follows).filter(F.col("user_id") != F.col("following"))
    return followed.select(F.col("user_id").alias("viewer_id"), F.col("following").alias("author_id")).unionByName(
        t.users.select(F.col("id").alias("viewer_id"), F.col("id").alias("author_id"))
    )


def home_feed_ids(
    newest: DataFrame, edges: DataFrame, hot: DataFrame, k: int = 5, page: int = 1
) -> DataFrame:
    """(viewer_id, author_id, post_id) of a page of every home feed, from each author's newest
    `k * page` posts."""
    # At most k * page ids per author.
    authors = newest.groupBy(F.col("user_id").alias("author_id")).agg(
        F.sort_array(F.collect_list("post_id"), asc=False).alias("post_ids")
    )
    offers = skew.spread_join(edges, authors, "author_id", "viewer_id", "inner", hot=hot)
    return _newest_offers(offers, k, page)


def _newest_offers(offers: DataFrame, k: int, page: int = 1) -> DataFrame:
    """The newest posts of every viewer, from rows (viewer_id, author_id, post_ids) with falling ids.

    A viewer's newest n posts come from the n followed authors with the newest post, so
    authors are cut to n before their posts are unpacked; both cuts share one shuffle.
    """
    offers = offers.withColumn("_newest", F.col("post_ids")[0])
    best_authors = top_k(offers, ["viewer_id"], [F.col("_newest").desc()], k * page)
    unpacked = best_authors.select("viewer_id", "author_id", F.explode("post_ids").alias("post_id"))
    return top_k(unpacked, ["viewer_id"], [F.col("post_id").desc()], k, page)


def author_blocks(posts: DataFrame, k: int) -> DataFrame:
    """(author_id, low, newer_low, post_ids): each author's posts in blocks of falling ids.

    A block holds `BLOCK` ids and the k that follow, so that the k ids below any of its own are in it. `low` is
    the least of its own ids and `newer_low` that of the block before, NULL for the newest.
    """
    by_author = Window.partitionBy("user_id")
    place = F.row_number().over(by_author.orderBy(F.col("post_id").desc())) - 1
    numbered = posts.select("user_id", "post_id", F.floor(place / BLOCK).alias("_block"))
    blocks = numbered.groupBy("user_id", "_block").agg(F.sort_array(F.collect_list("post_id"), asc=False).alias("_own"))
    order = by_author.orderBy("_block")
    blocks = blocks.withColumn("low", F.array_min("_own"))
    older = F.slice(F.coalesce(F.lead("_own").over(order), F.array().cast("array<bigint>")), 1, k)
    return blocks.select(
        F.col("user_id").alias("author_id"),
        "low",
        F.lag("low").over(order).alias("newer_low"),
        F.concat("_own", older).alias("post_ids"),
    )


def home_feed_ids_below(
    posts: DataFrame, edges: DataFrame, cursors: DataFrame, hot: DataFrame, k: int = 5
) -> DataFrame:
    """(viewer_id, author_id, post_id) of the newest k posts below each viewer's own cursor.

    Every edge takes the one block of its author that holds the newest post below the cursor, not
    the author's whole list. Viewers without a cursor start at the newest post.
    """
    if k > BLOCK:
        raise ValueError(f"pages of more than {BLOCK} posts do not fit a block and the one after it")
    own = edges.join(cursors.select("viewer_id", "cursor"), "viewer_id", "left")
    offers = skew.spread_join(own, author_blocks(posts, k), "author_id", "viewer_id", "inner", hot=hot)
    cursor = F.col("cursor")
    starts = F.when(cursor.isNull(), F.col("newer_low").isNull()).otherwise(
        (F.col("low") < cursor) & (F.col("newer_low").isNull() | (F.col("newer_low") >= cursor))
    )
    below = F.filter("post_ids", lambda i: F.col("cursor").isNull() | (i < F.col("cursor")))
    return _newest_offers(offers.filter(starts).withColumn("post_ids", F.slice(below, 1, k)), k)


def home_feed(
    t: SocialTables,
    k: int = 5,
    page: int = 1,
    cursor: int | DataFrame | None = None,
    viewers: DataFrame | None = None,
    marts: Marts | None = None,
) -> DataFrame:
    """For every viewer the newest k live root posts by followed users or themself.

    Page n holds the k posts that follow those of the pages before. `cursor` starts below a post id instead: one id
    for all feeds, or a frame (viewer_id, cursor) with each viewer's own, which shows no post twice when
    new ones arrive between two pages (`home_feed_cursors` gives the next page's). Only each author's newest
    `k * page` posts can appear on a page without a frame of cursors, so posts are cut to those
    before they meet the follow edges. Only ids are ranked; text is fetched by post id. An author followed
    by many is spread over salts: when edges meet authors, and again when feeds fetch the post.
    With `viewers` (viewer_id) only their feeds are built, from the posts of those they follow.
    """
    marts = marts or Marts.from_tables(t)
    edges, votes, hot = feed_edges(t), t.post_votes, marts.hot_followed
    ids = root_posts(t.post_facts).select("post_id", "user_id")
    if viewers is not None:
        edges = edges.join(viewers.select("viewer_id"), "viewer_id", "left_semi")
        votes = votes.join(viewers.select(F.col("viewer_id").alias("user_id")), "user_id", "left_semi")
        ids = ids.join(edges.select(F.col("author_id").alias("user_id")).distinct(), "user_id", "left_semi")

    if isinstance(cursor, DataFrame):
        if page != 1:
            raise ValueError("a frame of cursors says where the page starts; page must be 1")
        feed = home_feed_ids_below(ids, edges, cursor, hot, k)
        shown = feed.select("post_id", F.col("author_id").alias("user_id")).distinct()
    else:
        shown = keyset_page(ids, k * page, cursor, by="user_id")
        feed = home_feed_ids(shown, edges, hot, k, page)
    cards = _with_text_refs(t, post_cards(t, marts, shown))
    feed = feed.join(aggregates.viewer_vote(votes), ["viewer_id", "post_id"], "left")
    key = ["post_id", skew.SALT]
    shown_cards = (
        skew.one_salt(feed, "author_id", hot, "viewer_id")
        .drop("author_id")
        .join(skew.every_salt(cards, "user_id", hot), key)
        .drop(skew.SALT)
        .fillna(0, ["current_user_vote"])
    )
    return t.add_text(shown_cards)


def home_feed_cursors(feed: DataFrame) -> DataFrame:
    """(viewer_id, cursor): where each viewer's next page starts, below the least post id shown."""
    return feed.groupBy("viewer_id").agg(F.min("post_id").alias("cursor"))


def _with_text_refs(t: SocialTables, cards: DataFrame) -> DataFrame:
    """Adds what a page shows of the post itself, and its text or what finds it; both meet the ranked posts by post id only.

    `media_id` comes along, by which `with_media` adds a page's photos.
    """
    posts, finders = t.text_refs()
    wanted = ("post_id", "camp_id", "reply_to_id", "media_id", "creation_time", *finders)
    return cards.join(root_posts(posts).select(*[c for c in wanted if c in posts.columns]), "post_id")


def _with_text(t: SocialTables, cards: DataFrame) -> DataFrame:
    return t.add_text(_with_text_refs(t, cards))


def profile_feed(
    t: SocialTables,
    k: int = 10,
    cursor: int | DataFrame | None = None,
    viewer_id: int = 0,
    marts: Marts | None = None,
) -> DataFrame:
    """The newest k live root posts of every author, as one viewer sees them."""
    shown = keyset_page(root_posts(t.post_facts).select("post_id", "user_id"), k, cursor, by="user_id")
    return _with_text(t, post_cards(t, marts or Marts.from_tables(t), shown, viewer_id))


def top_of_day(t: SocialTables, k: int = 100, viewer_id: int = 0, marts: Marts | None = None) -> DataFrame:
    """Per local day the k live root posts with the highest score; unvoted ones come last.

    Every post belongs to the one day `local_day` gives; use `top_of_window` for the form
    where a post at exactly midnight shows on both days.
    """
    marts = marts or Marts.from_tables(t)
    roots = root_posts(t.post_facts).select(
        "post_id", "user_id", local_day(F.col("creation_time")).alias("day")
    )
    scored = roots.join(marts.figures.select("post_id", "post_score"), "post_id", "left")
    best = top_k(scored, ["day"], _by_post_score(), k, place="place").select("post_id", "user_id", "day", "place")
    return _with_text(t, post_cards(t, marts, best, viewer_id))


def top_of_window(
    t: SocialTables, posts: DataFrame, k: int = 100, viewer_id: int = 0, marts: Marts | None = None
) -> DataFrame:
    """The k live root posts with the highest score among `posts`, for example a `day_window`."""
    marts = marts or Marts.from_tables(t)
    roots = root_posts(posts).select("post_id", "user_id")
    scored = roots.join(marts.figures.select("post_id", "post_score"), "post_id", "left")
    best = scored.orderBy(*_by_post_score()).limit(k)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(*_by_post_score()))).drop("post_score")
    return _with_text(t, post_cards(t, marts, best, viewer_id))


def top_of_nth_day(
    t: SocialTables, offset: int = 0, k: int = 100, viewer_id: int = 0, marts: Marts | None = None
) -> DataFrame:
    """The board of the active day `offset` places back, both of its midnights included, as one plan.

    The day is a scalar subquery, so nothing runs while the plan is built.
    """
    day = nth_active_day(t.post_facts, offset).select("day").scalar()
    start = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(LOCAL_OFFSET_HOURS))
    end = start + F.make_dt_interval(F.lit(1))
    return top_of_window(t, t.post_facts.filter(F.col("creation_time").between(start, end)), k, viewer_id, marts)


def _by_post_score():
    return [F.col("post_score").desc_nulls_last(), F.col("post_id").desc()]


def _days(posts: DataFrame) -> DataFrame:
    """One row per local day with a live root post: a short list however many posts there are."""
    return root_posts(posts).select(local_day(F.col("creation_time")).alias("day")).distinct()


def active_days(posts: DataFrame) -> DataFrame:
    """Local days with a live root post, newest first, numbered from 0."""
    newest_first = Window.orderBy(F.col("day").desc())
    return _days(posts).withColumn("day_offset", (F.row_number().over(newest_first) - 1).cast("bigint"))


def nth_active_day(posts: DataFrame, offset: int = 0) -> DataFrame:
    """The active day `offset` places back from the newest."""
    return _days(posts).orderBy(F.col("day").desc()).offset(offset).limit(1)


def format_feed(feed: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """Display form of a feed: labels, level and bars, age, dates, shortened text."""
    zero = F.lit(0)
    text = F.col("post_text")
    counts = ("reply_count", "up_votes", "down_votes")
    columns = {
        **{c: F.coalesce(c, zero) for c in counts},
        **{f"{c}_label": blank_zero(F.col(c)) for c in counts},
        "post_score": F.coalesce("post_score", zero),
        "user_level": level(F.col("user_score")),
        "user_score_bars": score_bars(F.col("user_score")),
        "time_ago": time_ago(F.col("creation_time"), as_of),
        "creation_date": display_date(F.col("creation_time")),
        "date_display": display_day(F.col("creation_time")),
        "post_length": F.length(text),
        "post_length_flag": is_long_post(text).cast("int"),
        "post_text": truncate_post(text),
        "profile_photo": default_photo(F.col("profile_photo")),
    }
    kept = [F.col(c) for c in feed.columns if c not in columns]
    return feed.select(*kept, *[expr.alias(name) for name, expr in columns.items()])
