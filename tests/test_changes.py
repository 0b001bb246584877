import datetime as dt

import pytest
from pyspark.sql import functions as F

from rookery.operators import changes

T = [dt.datetime(2022, 1, d) for d in range(1, 29)]


@pytest.mark.parametrize(
    "rule, expected", [("exact", [1, -1, 0, 0, 0, 0]), ("sign", [1, -1, 1, 1, 1, -1])]
)
def test_normalise_votes(spark, rule, expected):
    raw = [1.0, -1.0, 0.0, 0.5, 7.0, -0.1]
    df = spark.createDataFrame(list(enumerate(raw)), "i INT, raw_value DOUBLE")
    assert [r.value for r in changes.normalise_votes(df, rule).orderBy("i").collect()] == expected


def test_unknown_vote_rule(spark):
    with pytest.raises(ValueError):
        changes.normalise_votes(spark.range(1), "other")


VOTES = "camp_id BIGINT, user_id BIGINT, post_id BIGINT, value INT, added_time TIMESTAMP_NTZ"


def votes(spark, data):
    return spark.createDataFrame(data, VOTES)


def test_self_votes_are_dropped(spark, rows):
    posts = spark.createDataFrame([(1, 10), (2, 20)], "post_id BIGINT, user_id BIGINT")
    events = votes(spark, [(0, 10, 1, 1, T[0]), (0, 10, 2, 1, T[0])])
    assert rows(changes.reject_self_votes(events, posts), "post_id", "user_id") == [(2, 10)]


def test_last_vote_wins_and_zero_stays(spark, rows):
    events = votes(spark, [(0, 1, 5, 1, T[0]), (0, 1, 5, -1, T[1]), (0, 1, 5, 0, T[2])])
    got = changes.apply_votes(votes(spark, []), events)
    assert rows(got) == [(0, 1, 5, 0, T[2])]


def test_apply_votes_updates_inserts_and_keeps(spark, rows):
    snapshot = votes(spark, [(0, 1, 5, 1, T[3]), (0, 2, 5, 1, T[3]), (0, 3, 5, 1, T[9])])
    events = votes(spark, [(0, 2, 5, -1, T[5]), (0, 4, 5, 1, T[5]), (0, 3, 5, -1, T[5])])
    got = changes.apply_votes(snapshot, events)
    assert rows(got, "user_id", "value") == [(1, 1), (2, -1), (3, 1), (4, 1)]  # user 3 voted later than the event


def test_a_batch_applied_twice_changes_nothing(spark, rows):
    snapshot = votes(spark, [(0, u, p, 1, T[u]) for u in range(5) for p in range(5)])
    events = votes(spark, [(0, u, p, -1, T[u + p]) for u in range(3, 8) for p in range(3, 8)])
    once = changes.apply_votes(snapshot, events)
    assert rows(changes.apply_votes(once, events)) == rows(once)
    assert once.select(*changes.VOTE_KEY).distinct().count() == once.count()


def test_hot_vote_key_is_exact(spark, rows):
    events = spark.range(20000).select(
        F.lit(0).cast("bigint").alias("camp_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("user_id"),
        F.lit(1).cast("bigint").alias("post_id"),
        F.col("id").cast("int").alias("value"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("added_time"),
    )
    got = changes.apply_votes(events.limit(0), events)
    expected = {}
    for i in range(20000):
        expected[7 if i % 3 == 0 else i % 50] = i
    assert rows(got, "user_id", "value") == sorted(expected.items())


FOLLOWS = "user_id BIGINT, following BIGINT, follow_value INT, creation_time TIMESTAMP_NTZ"


def test_apply_follows(spark, rows):
    empty = spark.createDataFrame([], FOLLOWS)
    events = spark.createDataFrame(
        [
            (1, 2, 1, T[0]),
            (1, 2, 5, T[1]),  # follow twice, larger values count as 1
            (1, 3, 1, T[0]),
            (1, 3, 0, T[1]),
            (1, 3, 1, T[2]),  # follow, unfollow, follow
            (1, 4, 1, T[0]),
            (1, 4, -1, T[1]),
            (5, 5, 1, T[0]),  # self
        ],
        FOLLOWS,
    )
    got = changes.apply_follows(empty, events)
    assert rows(got, "user_id", "following", "follow_value") == [(1, 2, 1), (1, 3, 1), (1, 4, 0)]


def test_only_the_owner_deletes(spark, rows):
    posts = spark.createDataFrame([(1, 10, 0), (2, 20, 0), (3, 30, 1)], "post_id BIGINT, user_id BIGINT, is_deleted INT")
    requests = spark.createDataFrame([(1, 10), (1, 10), (2, 10)], "post_id BIGINT, user_id BIGINT")
    assert rows(changes.apply_post_deletes(posts, requests)) == [(1, 10, 1), (2, 20, 0), (3, 30, 1)]


def test_mark_notifications_seen(spark, rows, monkeypatch):
    monkeypatch.setattr("rookery.operators.skew.ROWS_PER_SALT", 1)
    notes = spark.createDataFrame(
        [(1, 10, 0, None, T[1]), (2, 10, 1, T[2], T[1]), (3, 10, 0, None, T[6]), (4, 20, 0, None, T[1])],
        "notification_id BIGINT, user_id BIGINT, seen INT, seen_time TIMESTAMP_NTZ, creation_time TIMESTAMP_NTZ",
    )
    requests = spark.createDataFrame([(10, T[3]), (10, T[5])], "user_id BIGINT, seen_time TIMESTAMP_NTZ")
    got = changes.mark_notifications_seen(notes, requests)
    assert rows(got, "notification_id", "seen", "seen_time") == [(1, 1, T[5]), (2, 1, T[2]), (3, 0, None), (4, 0, None)]


def test_profile_edits(spark, rows):
    users = spark.createDataFrame(
        [(1, "ann", "old", "a.png"), (2, "bob", None, None)],
        "id BIGINT, first_name STRING, bio STRING, profile_photo STRING",
    )
    edits = spark.createDataFrame(
        [
            (1, "Ann", "new", "b.png", T[1]),
            (1, "Anna", "newer", "", T[2]),  # no photo: the one of the edit before stays
            (1, "Annie", "older", None, T[0]),
        ],
        "user_id BIGINT, first_name STRING, bio STRING, profile_photo STRING, edit_time TIMESTAMP_NTZ",
    )
    assert rows(changes.apply_profile_edits(users, edits)) == [(1, "Anna", "newer", "b.png"), (2, "bob", None, None)]


def test_tokens_and_camps(spark, rows):
    tokens = spark.createDataFrame([("a", None), ("b", 0), ("c", 1)], "token STRING, used INT")
    uses = spark.createDataFrame([("b",), ("b",), ("zz",)], "token STRING")
    assert rows(changes.consume_tokens(tokens, uses)) == [("a", None), ("b", 1), ("c", 1)]
    directory = spark.createDataFrame([(1, 0, 5)], "record_id BIGINT, camp_id BIGINT, user_id BIGINT")
    requests = spark.createDataFrame([(0, 5), (1, 5), (1, 5)], "camp_id BIGINT, user_id BIGINT")
    assert rows(changes.join_camp(directory, requests), "camp_id", "user_id") == [(0, 5), (1, 5)]


def test_changes_apply_to_tables_with_the_full_schema(spark, rows):
    from rookery.sources.tables import conform

    stored = spark.createDataFrame([(77, 0, 1, 5, "1", T[0])], "vote_id BIGINT, camp_id BIGINT, user_id BIGINT, post_id BIGINT, value STRING, added_time TIMESTAMP_NTZ")
    snapshot = conform(stored, "post_votes")
    got = changes.apply_votes(snapshot, votes(spark, [(0, 1, 5, -1, T[1]), (0, 2, 5, 1, T[1])]))
    assert got.schema.simpleString() == snapshot.schema.simpleString()
    found = [(i, u, int(v)) for i, u, v in rows(got, "vote_id", "user_id", "value")]
    assert found == [(None, 2, 1), (77, 1, -1)]

    notes = conform(spark.createDataFrame([(1, 10, 0, T[0])], "notification_id BIGINT, user_id BIGINT, seen INT, creation_time TIMESTAMP_NTZ"), "notifications")
    requests = spark.createDataFrame([(10, T[1])], "user_id BIGINT, seen_time TIMESTAMP_NTZ")
    assert rows(changes.mark_notifications_seen(notes, requests), "seen", "seen_time") == [(1, T[1])]

    directory = conform(spark.createDataFrame([(1, 0, 5)], "record_id BIGINT, camp_id BIGINT, user_id BIGINT"), "camp_directory")
    asked = spark.createDataFrame([(1, 5, T[3]), (1, 5, T[2])], "camp_id BIGINT, user_id BIGINT, added_time TIMESTAMP_NTZ")
    joined = changes.join_camp(directory, asked)
    assert rows(joined, "camp_id", "added_time") == [(0, None), (1, T[2])]
