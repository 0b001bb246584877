import datetime as dt

import pytest
from pyspark.sql import functions as F

from rookery.operators import joins, predicates

POSTS = "post_id BIGINT, user_id BIGINT, reply_to_id BIGINT, is_deleted INT, creation_time TIMESTAMP_NTZ"
T0 = dt.datetime(2022, 1, 1)


@pytest.fixture
def posts(spark):
    data = [(1, 10, None, 0), (2, 10, None, 1), (3, 20, 1, 0), (4, 20, 1, 1), (5, 20, 2, 0), (6, 10, None, 0)]
    return spark.createDataFrame([(*d, T0) for d in data], POSTS)


def test_roots_and_replies(posts, rows):
    assert rows(predicates.root_posts(posts), "post_id") == [(1,), (6,)]
    assert rows(predicates.live_replies(posts), "post_id") == [(3,), (5,)]
    roots = predicates.root_posts(posts)
    assert rows(predicates.live_replies(posts, roots), "post_id") == [(3,)]


def test_paging_covers_everything_once(spark, rows, monkeypatch):
    monkeypatch.setattr("rookery.operators.skew.ROWS_PER_SALT", 5)
    df = spark.range(1, 200).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).alias("user_id")
    )
    seen, cursor = [], None
    for _ in range(40):
        page = predicates.keyset_page(df, 30, cursor, by="user_id").cache()
        found = rows(page, "user_id", "post_id")
        if not found:
            break
        seen += found
        lowest = predicates.next_cursor(page, "user_id")
        if cursor is not None:  # authors that ran out keep their last cursor
            lowest = lowest.unionByName(cursor.join(lowest, "user_id", "left_anti"))
        cursor = spark.createDataFrame(lowest.collect(), "user_id BIGINT, cursor BIGINT")
    assert sorted(seen) == rows(df, "user_id", "post_id")
    first = predicates.keyset_page(df, 5)
    assert rows(first, "post_id") == [(i,) for i in range(195, 200)]
    assert rows(predicates.keyset_page(df, 2, 195), "post_id") == [(193,), (194,)]


def test_restrict_ids_with_a_hot_id(spark, rows, monkeypatch):
    monkeypatch.setattr("rookery.operators.skew.ROWS_PER_SALT", 10)
    df = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    ids = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k BIGINT")
    expected = [(i,) for i in range(300) if i % 3 == 0 or i in (1, 2)]
    assert rows(predicates.restrict_ids(df, ids, "k", "id"), "id") == expected


def test_day_window_has_both_midnights(spark, rows):
    times = [dt.datetime(2022, 1, 1, 4, 59, 59), dt.datetime(2022, 1, 1, 5), dt.datetime(2022, 1, 2, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i INT, creation_time TIMESTAMP_NTZ")
    assert rows(predicates.day_window(df, dt.date(2022, 1, 1)), "i") == [(1,), (2,)]
    assert rows(predicates.day_window(df, dt.date(2022, 1, 2)), "i") == [(2,)]


@pytest.mark.parametrize(
    "day, start, end",
    [
        ((2022, 1, 1), (2022, 1, 1), (2022, 4, 1)),
        ((2022, 5, 31), (2022, 4, 1), (2022, 7, 1)),
        ((2022, 9, 30), (2022, 7, 1), (2022, 10, 1)),
        ((2022, 12, 31), (2022, 10, 1), (2023, 1, 1)),
    ],
)
def test_quarter_bounds(day, start, end):
    assert predicates.quarter_bounds(dt.date(*day)) == (dt.datetime(*start), dt.datetime(*end))


def test_search(spark, rows):
    people = [(1, "Dave_9", "David", T0 + dt.timedelta(2)), (2, "ann", "Dave", T0), (3, "bob", "Bob", T0), (4, "x", None, T0)]
    users = spark.createDataFrame(people, "id BIGINT, handle STRING, first_name STRING, creation_time TIMESTAMP_NTZ")
    assert [r.id for r in predicates.search_users(users, "DAVE").collect()] == [2, 1]
    assert [r.id for r in predicates.search_users(users, "DAVE", k=1).collect()] == [2]
    assert predicates.search_users(users, "_").count() == 4
    assert rows(predicates.search_users(users, "b_b"), "id") == [(3,)]
    assert rows(predicates.search_users(users, "d\\ave_\\"), "id") == []  # ends in an escaped percent sign
    assert rows(predicates.search_users(users, "D\\ave"), "id") == [(1,), (2,)]
    many = predicates.search_users_many(users, ["dave", "bob", "dave", "zzz"], k=1)
    assert rows(many, "term", "id") == [("bob", 3), ("dave", 2)]
    assert rows(predicates.user_by_handle(users, "DAVE_9"), "id") == [(1,)]


def test_follow_status_and_edges(spark, rows):
    follows = spark.createDataFrame(
        [(1, 2, 1), (1, 2, 1), (1, 3, 0), (2, 1, 1)], "user_id BIGINT, following BIGINT, follow_value INT"
    )
    assert rows(joins.active_follow_edges(follows)) == [(1, 2), (2, 1)]
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "viewer_id BIGINT, user_id BIGINT")
    assert rows(joins.follow_status(follows, pairs)) == [(1, 2, 1), (1, 3, 0), (3, 1, 0)]


def test_with_media_keeps_every_photo(spark, rows):
    posts = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "post_id BIGINT, media_id BIGINT")
    media = spark.createDataFrame([(5, "a"), (5, "b")], "media_id BIGINT, photo_url STRING")
    got = joins.with_media(posts, media)
    assert rows(got, "post_id", "photo_url") == [(1, "a"), (1, "b"), (2, None), (3, None)]


def test_last_vote(spark, rows):
    data = [(1, 7, -1, T0), (1, 7, -1, T0 + dt.timedelta(1)), (1, 7, 1, T0 + dt.timedelta(2)), (2, 7, 1, T0)]
    votes = spark.createDataFrame(data, "post_id BIGINT, user_id BIGINT, value INT, added_time TIMESTAMP_NTZ")
    assert rows(joins.last_vote(votes)) == [(1, 7, T0 + dt.timedelta(1), -1)]
    assert rows(joins.last_vote(votes, down_only=False)) == [(1, 7, T0 + dt.timedelta(2), 1), (2, 7, T0, 1)]


def test_resolve_handles(spark, rows):
    users = spark.createDataFrame([(1, "Ann"), (2, "bob")], "id BIGINT, handle STRING")
    events = spark.createDataFrame([(5, "ANN"), (6, "nobody")], "user_id BIGINT, handle STRING")
    assert rows(joins.resolve_handles(events, users)) == [(5, 1)]
    twins = spark.createDataFrame([(3, "Bob"), (2, "bob")], "id BIGINT, handle STRING")
    assert rows(joins.resolve_handles(spark.createDataFrame([(5, "bob")], events.schema), twins)) == [(5, 2)]
