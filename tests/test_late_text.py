"""Texts that lie in another table are found last, and are shuffled to no post."""

import re

import pytest
from pyspark.sql import functions as F

from rookery.plans import camps, feeds, threads
from rookery.plans.marts import Marts
from rookery.sources.star import StarSource
from rookery.sources.tables import LateText, SocialTables

PAGES = {
    "home_feed": lambda t, marts: feeds.home_feed(t, marts=marts),
    "profile_feed": lambda t, marts: feeds.profile_feed(t, marts=marts),
    "post_detail": lambda t, marts: threads.post_detail(t, 8, marts),
    "thread": lambda t, marts: threads.thread(t, viewer_id=8, marts=marts, heads=t.post_facts.select("post_id").filter("post_id % 50 = 0")),
    "camp_wall": lambda t, marts: camps.camp_wall(t, 1, name="first_name", marts=marts),
}


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark, df):
    """What each shuffle of the plan takes in, by the columns' names."""
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(formatted)
    return [set(re.findall(r"(\w+)#", columns)) for columns in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)]


@pytest.mark.parametrize("page", ["home_feed", "profile_feed", "post_detail", "camp_wall"])
def test_pages_shuffle_no_text_of_posts(spark, no_broadcast, page):
    t = StarSource(spark, "/root/testdata/sf0.001").tables()
    taken = shuffled(spark, PAGES[page](t, Marts.from_tables(t)))
    assert not any("post_text" in names for names in taken)
    # Only the documents themselves are.
    assert [names for names in taken if "text" in names] == [{"text_key", "text"}]


@pytest.mark.parametrize("page", PAGES)
def test_pages_are_those_of_plain_tables(spark, rows, social, page):
    """With posts, references and texts that come twice, and a reference that leads nowhere."""
    posts = [
        {"post_id": i, "user_id": i % 5, "camp_id": i % 2, "is_deleted": int(i % 7 == 3), "reply_to_id": i - 1 if i % 3 else None, "post_text": f"{i % 4}-words {i % 4}" if i % 4 else None}
        for i in [*range(60), 6, 12]
    ]
    follows = [{"user_id": u, "following": f, "follow_value": 1} for u in range(5) for f in range(5) if u != f]
    plain = social(users=[{"id": i, "handle": f"u{i}", "first_name": f"n{i % 2}"} for i in range(5)], posts=posts, follows=follows)
    texts = spark.createDataFrame([(1, "words 1"), (2, "words 2"), (2, "words 2"), (3, "words 3"), (None, "none")], "k INT, text STRING")
    refs = lambda: plain.posts.drop("post_text").withColumn("k", F.nullif(F.col("post_id") % 4, F.lit(0)).cast("int"))
    add = lambda df: df.join(texts, "k").withColumn("post_text", F.concat(F.col("k").cast("string"), F.lit("-"), "text")).drop("k", "text")
    late = SocialTables(LateText(refs, ("k",), add), **{**plain.frames(), "posts": add(refs()), "post_facts": plain.post_facts})
    joined = plain.with_frames(posts=add(refs())).with_frames(post_facts=plain.post_facts)
    marts = Marts.from_tables(plain)
    expected = PAGES[page](joined, marts)
    found = rows(PAGES[page](late, marts), *expected.columns)
    assert found and found == rows(expected)


def test_a_batch_of_posts_reads_its_texts_once(spark, social, tmp_path):
    from rookery.streaming import notices

    posts = social(posts=[{"post_id": i, "user_id": i % 3, "reply_to_id": i - 1 if i else None, "post_text": "hi @u1" if i % 2 else None} for i in range(20)]).posts
    path = str(tmp_path / "s")
    posts.drop("post_text").write.parquet(f"{path}/posts")
    texts = posts.select(F.col("post_id").alias("k"), "post_text")
    texts.write.parquet(f"{path}/texts")
    stream = spark.readStream.schema(posts.drop("post_text").schema).parquet(f"{path}/posts")
    joined = stream.join(spark.read.parquet(f"{path}/texts"), F.col("k") == F.col("post_id"))
    users = social(users=[{"id": i, "handle": f"u{i}"} for i in range(3)]).users
    notices.stream_post_notifications(joined, lambda: posts, lambda: users, path).awaitTermination()
    # What is kept of a batch has the names and no text.
    kept = spark.read.parquet(f"{path}/read")
    assert "post_text" not in kept.columns and kept.count() == 20
    found = notices.read_notices(spark, path)
    assert found.count() == 19 + 10


def test_tables_by_post_without_texts(spark, social, tmp_path):
    from rookery.operators import joins
    from rookery.sources import colocated

    t = social(posts=[{"post_id": i, "user_id": 1, "post_text": "x"} for i in range(20)])
    marts, path = Marts.from_tables(t), str(tmp_path / "by")
    colocated.save_by_post(t, marts, "no_texts", path, 4, ("facts", "figures"))
    loaded, figures = colocated.load_by_post(t, marts, "no_texts", texts=False)
    assert joins.with_post_stats(loaded.post_facts, figures.figures).count() == 20
    assert not (tmp_path / "by" / "texts").exists()


def test_sorts_of_posts_grow_in_number(spark, social, tmp_path, monkeypatch):
    from rookery.sources import tables

    t = social(posts=[{"post_id": i, "post_text": "x"} for i in range(200)])
    monkeypatch.setattr(tables, "POSTS_PER_TASK", 10)
    tables.save_tables(t, str(tmp_path / "t"))
    saved = spark.read.parquet(str(tmp_path / "t" / "posts"))
    assert len(saved.inputFiles()) > 10 and saved.count() == 200


def test_posts_without_a_text_do_not_arrive(spark):
    s = StarSource(spark, "/root/testdata/sf0.001")
    assert sorted(r.post_id for r in s.post_arrivals().collect()) == sorted(r.post_id for r in s.posts().select("post_id").collect())
    few = s.read("documents").limit(0).select(F.col("doc_id"), "text")

    class Empty(StarSource):
        def read(self, name):
            return few if name == "documents" else StarSource.read(self, name)

    assert Empty(spark, "/root/testdata/sf0.001").post_refs().count() > 0 == Empty(spark, "/root/testdata/sf0.001").post_arrivals().count()


def test_buckets_hold_no_text_that_lies_elsewhere(spark, rows, tmp_path, no_broadcast):
    from rookery.sources import colocated

    t = StarSource(spark, "/root/testdata/sf0.001").tables()
    marts, path = Marts.from_tables(t), str(tmp_path / "by")
    colocated.save_by_post(t, marts, "late_texts", path, 4)
    assert set(spark.table("late_texts_texts").columns) == {"post_id", "is_deleted", *StarSource.FINDERS}
    bucketed, figures = colocated.load_by_post(t, marts, "late_texts")
    page = threads.post_detail(bucketed, 8, figures)
    taken = shuffled(spark, page)
    assert [names for names in taken if "text" in names or "post_text" in names] == [{"text_key", "text"}]
    # What texts are found by is read where the posts are.
    assert sum("greeting" in names for names in taken) == 1
    expected = threads.post_detail(t.with_frames(posts=t.posts, post_facts=t.post_facts), 8, marts)
    assert rows(page, *expected.columns) == rows(expected) and page.count() > 0
    assert rows(bucketed.posts, "post_id", "post_text") == rows(t.posts, "post_id", "post_text")
