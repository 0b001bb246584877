import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rookery import session
from rookery.sources import sinks
from rookery.sources.schemas import NUMERIC_KEY, SOCIAL
from rookery.sources.tables import SocialTables, conform, jdbc_options, load_tables, save_tables

T0 = dt.datetime(2022, 1, 1)


def test_save_and_load(spark, social, rows, tmp_path):
    t = social(users=[{"id": 1, "handle": "ann"}], posts=[{"post_id": 1, "user_id": 1, "post_text": "x", "is_deleted": 0}])
    save_tables(t, str(tmp_path / "s"))
    loaded = load_tables(spark, str(tmp_path / "s"))
    assert set(loaded.frames()) == set(SOCIAL)
    assert rows(loaded.posts, "post_id", "post_text") == [(1, "x")]
    assert "post_text" not in loaded.post_facts.columns
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        save_tables(t, str(tmp_path / "s"))


def test_replacing_a_table_replaces_its_facts(spark, social):
    t = social(posts=[{"post_id": 1, "user_id": 1, "is_deleted": 0}])
    assert t.post_facts.count() == 1
    other = t.with_frames(posts=t.posts.filter("post_id = 2"))
    assert other.post_facts.count() == 0 and t.post_facts.count() == 1
    with pytest.raises(ValueError):
        SocialTables(other=t.posts)
    with pytest.raises(AttributeError):
        SocialTables(users=t.users).posts  # noqa: B018


def test_conform_adds_missing_columns(spark):
    df = conform(spark.createDataFrame([(1, 2, "1.5")], "camp_id INT, post_id INT, value STRING"), "post_votes")
    row = df.first()
    assert (row.camp_id, row.post_id, str(row.value), row.vote_id) == (1, 2, "1.500", None)


def test_append_partitions_by_day(spark, rows, tmp_path):
    path = str(tmp_path / "votes")
    first = spark.createDataFrame([(1, T0), (2, T0 + dt.timedelta(days=1))], "id INT, added_time TIMESTAMP_NTZ")
    sinks.append_events(first, path, "added_time")
    sinks.append_events(first.filter("id = 1"), path, "added_time")
    table = spark.read.parquet(path)
    assert rows(table.select("id", F.col("event_day").cast("string"))) == [
        (1, "2022-01-01"),
        (1, "2022-01-01"),
        (2, "2022-01-02"),
    ]
    plan = table.filter("event_day = '2022-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan


def test_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "ä")], "a INT, b INT, c STRING")
    assert json.loads(sinks.export_json(df).first().json) == {"a": 1, "b": None, "c": "ä"}
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().c == "ä"


def test_jdbc_options_read_in_ranges():
    options = jdbc_options("posts", "jdbc:x", (1, 1000), 8, {"user": "u"})
    assert options["partitionColumn"] == NUMERIC_KEY["posts"] == "post_id"
    assert (options["lowerBound"], options["upperBound"], options["numPartitions"]) == ("1", "1000", "8")
    assert options["user"] == "u"


def test_work_dir_is_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = session.work_dir(spark, "a"), session.work_dir(spark, "a")
    assert first != second and first.startswith(base)


def test_tables_are_written_once(spark):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    key = ("test", "once")
    assert session.written_table(spark, key, make).count() == 3
    folder = session.written_folder(spark, key, lambda path: calls.append(path))
    assert session.written_table(spark, key, make).inputFiles()[0].removeprefix("file://").startswith(folder)
    assert not any(isinstance(c, str) for c in calls)


def test_saved_tables_are_filtered_by_layout(social, spark, tmp_path):
    from rookery.operators import predicates
    from rookery.sources.tables import load_tables, save_tables

    day = dt.date(2022, 1, 31)
    times = [dt.datetime(2022, 1, 31, 5), dt.datetime(2022, 1, 31, 4, 59), dt.datetime(2022, 2, 1, 5), dt.datetime(2022, 3, 1), None]
    posts = [{"post_id": i, "creation_time": t} for i, t in enumerate(times)]
    save_tables(social(posts=posts, users=[{"id": 1, "handle": "Ann"}, {"id": 2, "handle": "bob"}]), str(tmp_path / "t"))
    t = load_tables(spark, str(tmp_path / "t"))
    shown = predicates.day_window(t.posts, day)
    assert sorted(r.post_id for r in shown.collect()) == [0, 2]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "local_month" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    found = predicates.user_by_handle(t.users, "ANN")
    assert [r.id for r in found.collect()] == [1]
    assert "EqualTo(handle_lower,ann)" in found._jdf.queryExecution().executedPlan().toString()


def test_tables_written_for_a_folder_follow_its_files(spark, tmp_path):
    from rookery.session import folder_state

    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    before = folder_state(spark, str(tmp_path))
    spark.range(4).write.parquet(str(tmp_path / "b.parquet"))
    assert folder_state(spark, str(tmp_path)) != before == before


def test_work_folders_are_deleted_at_once(spark, tmp_path, monkeypatch):
    from rookery import session

    base = spark.conf.get("spark.checkpoint.dir")
    assert session.work_dir(spark, "thing").startswith(f"{base}/rookery/{spark.sparkContext.applicationId}/thing-")
    # As another application, so that the other tests keep their tables.
    monkeypatch.setattr(session, "_application_dir", lambda spark: str(tmp_path / "work"))
    monkeypatch.setattr(session, "_WRITTEN", {})
    one = session.written_folder(spark, ("x", "once"), lambda p: spark.range(2).write.parquet(p))
    assert (tmp_path / "work").exists() and session.written_folder(spark, ("x", "once"), None) == one
    session.discard_work(spark)
    assert not (tmp_path / "work").exists()
    assert session.written_folder(spark, ("x", "once"), lambda p: spark.range(2).write.parquet(p)) != one
