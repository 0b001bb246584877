import datetime as dt
import random

import pytest

from rookery.operators import aggregates, changes, notices
from rookery.streaming import activity, notices as notice_stream, scores as score_stream, votes as vote_stream

T0 = dt.datetime(2022, 1, 1)
EVENTS = "camp_id BIGINT, user_id BIGINT, post_id BIGINT, raw_value DOUBLE, added_time TIMESTAMP_NTZ, seq BIGINT"


def add_file(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def test_vote_stream_equals_batch_with_late_events_and_restarts(spark, rows, tmp_path):
    rng = random.Random(5)
    # Event order is not arrival order.
    events = [
        (0, rng.randrange(6), rng.randrange(5), rng.choice([1.0, -1.0, 0.5]), T0 + dt.timedelta(hours=rng.randrange(50)), i)
        for i in range(200)
    ]
    posts = spark.createDataFrame([(p, p) for p in range(5)], "post_id BIGINT, user_id BIGINT")
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    for start in range(0, 200, 50):  # each round is a restart from the checkpoint
        add_file(spark.createDataFrame(events[start : start + 50], EVENTS), source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        vote_stream.stream_votes(stream, lambda: posts, out, tie_break=["seq"]).awaitTermination()
    everything = spark.createDataFrame(events, EVENTS)
    valid = changes.reject_self_votes(changes.normalise_votes(everything), posts)
    expected = changes.latest_by_key(valid, changes.VOTE_KEY, ["added_time", "seq"])
    expected = rows(expected, *vote_stream.VOTE_COLUMNS)
    assert rows(vote_stream.current_votes(spark, out, tie_break=["seq"])) == expected
    assert vote_stream.read_deltas(spark, out).count() <= valid.count()

    # The same on top of a snapshot, and as the next snapshot.
    snapshot = spark.createDataFrame(
        [(0, 0, 1, 1, T0 + dt.timedelta(days=9)), (0, 99, 1, 1, T0)],
        "camp_id BIGINT, user_id BIGINT, post_id BIGINT, value INT, added_time TIMESTAMP_NTZ",
    )
    target = str(tmp_path / "snapshot")
    last = vote_stream.compact(spark, out, target, snapshot, tie_break=["seq"])
    merged = {r[:3]: r for r in expected}
    merged.update({(0, 0, 1): (0, 0, 1, 1, T0 + dt.timedelta(days=9)), (0, 99, 1): (0, 99, 1, 1, T0)})
    compacted = spark.read.parquet(target)
    assert rows(compacted, *vote_stream.VOTE_COLUMNS) == sorted(merged.values())

    # With the new snapshot only later batches are read.
    newer = [(0, 4, 1, 1.0, T0 + dt.timedelta(days=20), 999)]
    add_file(spark.createDataFrame(newer, EVENTS), source)
    stream = spark.readStream.schema(EVENTS).parquet(source)
    vote_stream.stream_votes(stream, lambda: posts, out, tie_break=["seq"]).awaitTermination()
    assert vote_stream.read_deltas(spark, out, after=last).count() == 1
    merged[0, 4, 1] = (0, 4, 1, 1, T0 + dt.timedelta(days=20))
    got = vote_stream.current_votes(spark, out, compacted, ["seq"], after=last)
    assert rows(got, *vote_stream.VOTE_COLUMNS) == sorted(merged.values())

    # Retired deltas are gone; the snapshot and later batches give the same votes.
    vote_stream.retire_deltas(spark, out, last)
    assert vote_stream.read_deltas(spark, out).count() == 1
    assert rows(vote_stream.current_votes(spark, out, compacted, ["seq"]), *vote_stream.VOTE_COLUMNS) == sorted(merged.values())


def test_notification_streams_equal_batch(spark, rows, tmp_path):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cat")], "id BIGINT, handle STRING")
    schema = "post_id BIGINT, user_id BIGINT, reply_to_id BIGINT, post_text STRING, creation_time TIMESTAMP_NTZ"
    posts = [
        (i, 1 + i % 3, i - 2 if i % 2 and i > 2 else None, f"hello @{['ann', 'bob', 'x'][i % 3]}", T0 + dt.timedelta(hours=i))
        for i in range(20)
    ]
    source, out = str(tmp_path / "posts"), str(tmp_path / "out")
    for start in (0, 10):
        # The post table grows along with the stream; parents may be from the same round.
        add_file(spark.createDataFrame(posts[start : start + 10], schema), source)
        stream = spark.readStream.schema(schema).parquet(source)
        notice_stream.stream_post_notifications(
            stream, lambda: spark.read.parquet(source), lambda: users, out
        ).awaitTermination()
    follows = "user_id BIGINT, following BIGINT, follow_value INT, creation_time TIMESTAMP_NTZ"
    followed = spark.createDataFrame([(1, 2, 1, T0), (2, 2, 1, T0), (3, 1, 0, T0)], follows)
    add_file(followed, str(tmp_path / "follows"))
    notice_stream.stream_follow_notifications(
        spark.readStream.schema(follows).parquet(str(tmp_path / "follows")), out
    ).awaitTermination()

    whole = spark.createDataFrame(posts, schema)
    batch = (
        notices.reply_notifications(whole, whole)
        .unionByName(notices.mention_notifications(whole, users))
        .unionByName(notices.follow_notifications(followed))
    )
    assert rows(notice_stream.read_notices(spark, out), *notices.NOTICE_COLUMNS) == rows(batch, *notices.NOTICE_COLUMNS)


def test_daily_active_stream_equals_batch_on_closed_days(spark, rows, tmp_path):
    rng = random.Random(6)
    acts = [(rng.randrange(8), T0 + dt.timedelta(days=d, seconds=rng.randrange(86400))) for d in range(12) for _ in range(20)]
    schema = "user_id BIGINT, time TIMESTAMP_NTZ"
    source, out = str(tmp_path / "acts"), str(tmp_path / "out")
    late = [acts[70]]  # day 3, arrives with days 4 to 6, before day 3 closes
    del acts[70]
    for part in (acts[:79], late + acts[79:99], acts[99:]):
        add_file(spark.createDataFrame(part, schema), source)
        stream = spark.readStream.schema(schema).parquet(source)
        activity.stream_daily_active(stream, out).awaitTermination()
    got = rows(spark.read.parquet(f"{out}/days"), "day", "active_users")
    whole = spark.createDataFrame(acts + late, schema)
    per_day = {}
    for user, time in whole.collect():
        per_day.setdefault(str(time.date()), set()).add(user)
    expected = [(day, len(users)) for day, users in sorted(per_day.items())]
    assert got == expected[:-2]  # the newest day and the one before it are still open


def test_activity_is_votes_and_posts(spark):
    votes = spark.createDataFrame([(1, T0)], "user_id BIGINT, added_time TIMESTAMP_NTZ")
    posts = spark.createDataFrame([(1, T0), (2, T0)], "user_id BIGINT, creation_time TIMESTAMP_NTZ")
    assert aggregates.activity(votes, posts).count() == 3


VOTED_POSTS = "post_id BIGINT, user_id BIGINT"


def scored(rows, votes, posts):
    """Figures of posts and scores of authors, summed anew."""
    figures = aggregates.post_stats(votes)
    return rows(figures), rows(aggregates.author_score(posts, votes))


def test_kept_scores_equal_sums_over_all_votes(spark, rows, tmp_path):
    rng = random.Random(7)
    events = [
        (0, rng.randrange(6), rng.randrange(8), rng.choice([1.0, -1.0, 0.5]), T0 + dt.timedelta(hours=rng.randrange(30)), i)
        for i in range(240)
    ]
    posts = spark.createDataFrame([(p, p % 3) for p in range(8)], VOTED_POSTS)
    source, out = str(tmp_path / "events"), str(tmp_path / "out")
    layout = {"buckets": 2, "width": 3, "author_buckets": 2}
    for start in range(0, 240, 60):  # late events come in later rounds
        add_file(spark.createDataFrame(events[start : start + 60], EVENTS), source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        score_stream.stream_scores(stream, lambda: posts, out, tie_break=["seq"], **layout).awaitTermination()
        arrived = spark.createDataFrame(events[: start + 60], EVENTS)
        valid = changes.reject_self_votes(changes.normalise_votes(arrived), posts)
        votes = changes.latest_by_key(valid, changes.VOTE_KEY, ["added_time", "seq"])
        expected = scored(rows, votes, posts)
        got = rows(score_stream.post_figures(spark, out, **layout)), rows(score_stream.author_scores(spark, out, **layout))
        assert got == expected
    # A batch that is repeated whole, and a second time with the changes of its first attempt only.
    tables = score_stream.ScoreTables(spark, out, stream, ["seq"], **layout)
    last = tables.votes.versions()[-1] - 1
    score_stream.process_votes(tables, spark.createDataFrame(events[180:], EVENTS), last, lambda: posts)
    assert (rows(tables.posts.read()), rows(tables.authors.read())) == expected
    tables.take_in(last)
    assert (rows(tables.posts.read()), rows(tables.authors.read())) == expected


def test_a_batch_that_fails_half_way_counts_once(spark, rows, tmp_path, monkeypatch):
    posts = spark.createDataFrame([(1, 7), (2, 8)], VOTED_POSTS)
    first = spark.createDataFrame([(0, 1, 1, 1.0, T0, 1), (0, 2, 2, -1.0, T0, 2)], EVENTS)
    second = spark.createDataFrame([(0, 1, 1, -1.0, T0 + dt.timedelta(1), 3), (0, 3, 1, 1.0, T0, 4)], EVENTS)
    tables = score_stream.ScoreTables(spark, str(tmp_path), first, ["seq"], buckets=1, width=10, author_buckets=1)
    score_stream.process_votes(tables, first, 0, lambda: posts)

    def fail(rows, events):
        raise RuntimeError("lost")

    # The votes have taken the batch in, its figures have not.
    monkeypatch.setattr(score_stream, "add_by", lambda key: fail)
    with pytest.raises(RuntimeError):
        score_stream.process_votes(tables, second, 1, lambda: posts)
    monkeypatch.undo()
    assert tables.votes.versions()[-1] == 2 and tables.posts.versions()[-1] == 1
    score_stream.process_votes(tables, second, 1, lambda: posts)
    assert rows(tables.posts.read()) == [(1, 0, 1, 1), (2, -1, 0, 1)]
    assert rows(tables.authors.read()) == [(7, 0), (8, -1)]


def test_votes_on_posts_to_come_wait(spark, rows, tmp_path):
    known = [[(1, 7)], [(1, 7), (2, 8), (3, 9)]]
    events = [
        spark.createDataFrame([(0, 1, 1, 1.0, T0, 1), (0, 1, 2, 1.0, T0, 2), (0, 9, 3, 1.0, T0, 3), (0, 5, 4, 1.0, T0, 4)], EVENTS),
        spark.createDataFrame([(0, 1, 2, -1.0, T0 - dt.timedelta(1), 5)], EVENTS),
    ]
    tables = score_stream.ScoreTables(spark, str(tmp_path), events[0], ["seq"])
    for n, posts in enumerate(known):
        score_stream.process_votes(tables, events[n], n, lambda: spark.createDataFrame(posts, VOTED_POSTS))
        if n == 0:
            assert rows(tables.posts.read()) == [(1, 1, 1, 0)] and tables.waiting().count() == 3
    # The older vote on post 2 came later and loses; the one on post 3 was its author's.
    assert rows(tables.posts.read()) == [(1, 1, 1, 0), (2, 1, 1, 0)]
    assert rows(tables.waiting().select("post_id")) == [(4,)]


def test_replies_before_their_parents(spark, rows, tmp_path):
    rng = random.Random(8)
    schema = "post_id BIGINT, user_id BIGINT, reply_to_id BIGINT, post_text STRING, creation_time TIMESTAMP_NTZ"
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cat")], "id BIGINT, handle STRING")
    posts = [(i, 1 + i % 3, i - 2 if i % 2 and i > 2 else None, f"hello @{['ann', 'x'][i % 2]}", T0 + dt.timedelta(hours=i)) for i in range(40)]
    posts.append((40, 1, 99, "an answer to nothing", T0))
    arriving = rng.sample(posts, len(posts))
    source, out = str(tmp_path / "posts"), str(tmp_path / "out")
    waited = 0
    for start in range(0, 41, 14):
        add_file(spark.createDataFrame(arriving[start : start + 14], schema), source)
        stream = spark.readStream.schema(schema).parquet(source)
        # One round's posts are looked up without those of the round itself.
        before = spark.createDataFrame(arriving[:start], schema)
        notice_stream.stream_post_notifications(stream, lambda: before, lambda: users, out).awaitTermination()
        waited += notice_stream.pending_replies(spark, out).count()
    whole = spark.createDataFrame(posts, schema)
    batch = notices.reply_notifications(whole, whole).unionByName(notices.mention_notifications(whole, users))
    assert rows(notice_stream.read_notices(spark, out), *notices.NOTICE_COLUMNS) == rows(batch, *notices.NOTICE_COLUMNS)
    assert waited > 1 and rows(notice_stream.pending_replies(spark, out), "post_id") == [(40,)]
    # With a limit the lone answer is given up when newer replies have come.
    add_file(spark.createDataFrame([(50, 2, 98, "later", T0 + dt.timedelta(days=30))], schema), source)
    stream = spark.readStream.schema(schema).parquet(source)
    notice_stream.stream_post_notifications(stream, lambda: whole, lambda: users, out, wait_days=10).awaitTermination()
    assert rows(notice_stream.pending_replies(spark, out), "post_id") == [(50,)]


def test_votes_are_folded_after_several_batches(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(score_stream, "FOLD", 3)
    posts = spark.createDataFrame([(1, 7), (1, 7), (2, 8)], VOTED_POSTS)
    layout = {"buckets": 1, "width": 10, "author_buckets": 1}
    tables, seen = None, []
    for n in range(4):
        day = T0 + dt.timedelta(n)
        batch = spark.createDataFrame([(0, 1, 1, 1.0 if n % 2 == 0 else -1.0, day, n), (0, 1, 2, 1.0, T0, 0)], EVENTS)
        tables = score_stream.ScoreTables(spark, str(tmp_path), batch, ["seq"], **layout)
        score_stream.process_votes(tables, batch, n, lambda: posts)
        tables.retire(n)
        seen.append((tables.pending(n + 1), tables.votes.read().count()))
        if n < 2:  # a repeated post counts once more for each time its vote is repeated
            assert rows(tables.posts.read()) == [[(1, 2, 2, 0), (2, 1, 1, 0)], [(1, -6, -2, 4), (2, 1, 1, 0)]][n]
    # Only the third batch writes the table of votes: the last state of each vote with its copies.
    assert seen == [([0], 0), ([0, 1], 0), ([], 9), ([3], 9)]
    assert rows(tables.posts.read()) == [(1, -22, -10, 12), (2, 1, 1, 0)]
