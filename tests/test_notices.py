import datetime as dt

from rookery.operators import notices

T0 = dt.datetime(2022, 1, 1)


def test_follow_notifications(spark, rows):
    events = spark.createDataFrame(
        [(1, 2, 1, T0), (1, 3, 0, T0), (4, 4, 1, T0)],
        "user_id BIGINT, following BIGINT, follow_value INT, creation_time TIMESTAMP_NTZ",
    )
    assert rows(notices.follow_notifications(events)) == [(2, 1, 1, None, T0)]


POSTS = "post_id BIGINT, user_id BIGINT, reply_to_id BIGINT, post_text STRING, creation_time TIMESTAMP_NTZ"


def test_reply_notifications(spark, rows):
    posts = spark.createDataFrame([(1, 10, None, "", T0), (2, 20, 1, "", T0), (3, 10, 1, "", T0)], POSTS)
    assert rows(notices.reply_notifications(posts, posts)) == [(10, 20, 2, 1, T0)]


def test_mention_notifications(spark, rows):
    users = spark.createDataFrame([(1, "Ann"), (2, "bob")], "id BIGINT, handle STRING")
    posts = spark.createDataFrame(
        [
            (5, 2, None, "@ann @ann and @nobody", T0),  # twice, and an unknown name
            (6, 1, None, "I am @Ann", T0),  # oneself
            (7, 1, None, "none", T0),
        ],
        POSTS,
    )
    assert rows(notices.mention_notifications(posts, users)) == [(1, 1, 3, 6, T0), (1, 2, 3, 5, T0), (1, 2, 3, 5, T0)]
