import datetime as dt
import os
import random
from pathlib import Path

import pytest

from rookery.operators import changes
from rookery.sources.buckets import BucketedTable

T0 = dt.datetime(2022, 1, 1)
VOTES = "camp_id BIGINT, user_id BIGINT, post_id BIGINT, value INT, added_time TIMESTAMP_NTZ"


def files(path, version=None):
    found = Path(path, "data" if version is None else f"data/version={version}").rglob("*.parquet")
    return {str(f): f.stat().st_size for f in found}


def vote_rows(rng, n, posts, days):
    keys = {(0, rng.randrange(50), rng.choice(posts)) for _ in range(n)}
    return [(*k, rng.choice([-1, 0, 1]), T0 + dt.timedelta(days=rng.randrange(days))) for k in sorted(keys)]


@pytest.mark.parametrize(("near", "width"), [(None, 1), ("post_id", 100)])
def test_merged_buckets_equal_the_whole_merge(spark, rows, tmp_path, near, width):
    rng = random.Random(1)
    first = spark.createDataFrame(vote_rows(rng, 400, range(500), 9), VOTES)
    table = BucketedTable(spark, str(tmp_path), VOTES, changes.VOTE_KEY, 8, near, width)
    table.create(first)
    whole = first
    for n in range(3):
        batch = spark.createDataFrame(vote_rows(rng, 40, range(200 * n, 200 * n + 300), 12), VOTES)
        whole = spark.createDataFrame(changes.apply_votes(whole, batch).collect(), VOTES)
        table.merge(batch, changes.apply_votes)
        assert rows(table.read()) == rows(whole)
    assert table.versions() == [0, 1, 2, 3] and rows(table.read(0)) == rows(first)
    with pytest.raises(ValueError):
        table.create(first)


def test_a_small_batch_reads_and_writes_its_buckets_only(spark, rows, tmp_path, monkeypatch):
    rng = random.Random(2)
    table = BucketedTable(spark, str(tmp_path), VOTES, changes.VOTE_KEY, 1, "post_id", 100)
    table.create(spark.createDataFrame(vote_rows(rng, 20_000, range(10_000), 9), VOTES))
    before = files(tmp_path)
    assert len(table.manifest()) == 100 == len(before)
    # Votes on posts of one range: one bucket of a hundred.
    batch = spark.createDataFrame(vote_rows(rng, 30, range(4200, 4300), 12), VOTES)
    read = []

    def change(old, events):
        read.extend(old.inputFiles())
        return changes.apply_votes(old, events)

    assert table.merge(batch, change) == 1
    written = files(tmp_path, 1)
    assert len(written) == 1 and len(read) == 1
    assert sum(written.values()) < 0.02 * sum(before.values())
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in read) < 0.02 * sum(before.values())
    assert before.items() <= files(tmp_path).items()


def test_versions_are_written_once_and_retired(spark, rows, tmp_path):
    table = BucketedTable(spark, str(tmp_path), VOTES, changes.VOTE_KEY, 4)
    assert rows(table.read()) == [] and table.manifest() == {}
    one = spark.createDataFrame([(0, 1, 1, 1, T0), (0, 2, 2, -1, T0)], VOTES)
    two = spark.createDataFrame([(0, 1, 1, 0, T0 + dt.timedelta(1))], VOTES)
    assert table.merge(one, changes.apply_votes, 3) > 0
    assert table.merge(two, changes.apply_votes, 3) == 0  # the version is there: nothing changes
    assert rows(table.read()) == rows(one)
    # A failed attempt leaves data without a manifest; the version is simply written again.
    one.write.parquet(f"{tmp_path}/data/version=5/bucket=0")
    assert table.merge(two, changes.apply_votes, 5) == 1
    after = [(0, 1, 1, 0, T0 + dt.timedelta(1)), (0, 2, 2, -1, T0)]
    assert rows(table.read()) == after and rows(table.read(4)) == rows(one)
    table.retire(5)
    assert table.versions() == [5] and rows(table.read()) == after
    assert table.merge(one.limit(0), changes.apply_votes) == 0 and rows(table.read()) == after
    # All rows of a bucket may go.
    table.merge(one, lambda old, _: old.limit(0))
    assert rows(table.read()) == []


def test_every_change_job_works_on_buckets(spark, rows, tmp_path):
    posts = spark.createDataFrame([(i, i % 7, 0) for i in range(60)], "post_id BIGINT, user_id BIGINT, is_deleted INT")
    asked = spark.createDataFrame([(3, 3), (8, 1), (9, 5), (99, 1)], "post_id INT, user_id INT")
    seen = spark.createDataFrame([(i, i % 9, 0, T0 + dt.timedelta(hours=i), None) for i in range(60)], "notification_id BIGINT, user_id BIGINT, seen INT, creation_time TIMESTAMP_NTZ, seen_time TIMESTAMP_NTZ")
    looks = spark.createDataFrame([(2, T0 + dt.timedelta(hours=30)), (2, T0)], "user_id BIGINT, seen_time TIMESTAMP_NTZ")
    users = spark.createDataFrame([(i, f"n{i}", None, f"b{i}") for i in range(30)], "id BIGINT, first_name STRING, profile_photo STRING, bio STRING")
    edits = spark.createDataFrame([(4, "x", "p.png", "y", T0), (4, "z", "", "w", T0 + dt.timedelta(1))], "user_id BIGINT, first_name STRING, profile_photo STRING, bio STRING, edit_time TIMESTAMP_NTZ")
    tokens = spark.createDataFrame([(f"t{i}", 0) for i in range(30)], "token STRING, used INT")
    uses = spark.createDataFrame([("t3",), ("t3",), ("none",)], "token STRING")
    members = spark.createDataFrame([(i % 3, i) for i in range(30)], "camp_id BIGINT, user_id BIGINT")
    joins = spark.createDataFrame([(0, 3), (1, 3), (1, 3)], "camp_id BIGINT, user_id BIGINT")
    for name, table, keys, events, change, event_keys in [
        ("posts", posts, ["post_id"], asked, changes.apply_post_deletes, None),
        ("notices", seen, ["user_id"], looks, changes.mark_notifications_seen, None),
        ("users", users, ["id"], edits, changes.apply_profile_edits, ["user_id"]),
        ("tokens", tokens, ["token"], uses, changes.consume_tokens, None),
        ("members", members, ["camp_id", "user_id"], joins, changes.join_camp, None),
    ]:
        schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
        stored = BucketedTable(spark, str(tmp_path / name), schema, keys, 10)
        stored.create(table)
        assert 0 < stored.merge(events, change, keys=event_keys) <= 4
        assert rows(stored.read(), *table.columns) == rows(change(table, events), *table.columns)


def test_rows_without_an_event_take_no_part(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr("rookery.sources.buckets.FEW_EVENTS", 0)
    first = spark.createDataFrame([(0, u, 1, 1, T0) for u in range(200)], VOTES)
    table = BucketedTable(spark, str(tmp_path), VOTES, changes.VOTE_KEY, 1)
    table.create(first)
    batch = spark.createDataFrame([(0, 3, 1, -1, T0), (0, 999, 1, 1, T0)], VOTES)
    handed = []

    def change(old, events):
        handed.append(old.count())
        return changes.apply_votes(old, events)

    table.merge(batch, change)
    assert 1 <= handed[0] < 20 and rows(table.read()) == rows(changes.apply_votes(first, batch))
