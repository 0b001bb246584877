"""What the plans must and must not contain."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rookery.operators import predicates, ranking, skew
from rookery.registry.queries import queries

SF = "/root/testdata/sf0.001"
STREAMS = {name for name in queries() if name.startswith("stream_")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(queries()) - STREAMS))
def test_no_python_and_no_cartesian_product(spark, name):
    df = queries()[name](spark, SF)
    plan = plan_of(df)
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|PythonUDF", plan)
    assert "CartesianProduct" not in plan
    # The only cross joins are with the one row that holds a total.
    for line in re.findall(r"Join Cross.*", optimized(df)):
        assert "rightHint=(strategy=broadcast)" in line


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_top_k_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    plan = plan_of(ranking.top_k(df, ["k"], [F.col("id").desc()], 2))
    assert re.search(r"WindowGroupLimit.*Final", plan) and re.search(r"WindowGroupLimit.*Partial", plan)
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_windows_of_time_reach_the_scan(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "posts")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    spark.sql("SELECT 1L AS post_id, TIMESTAMP_NTZ'2022-01-01 00:00:00' AS creation_time, 'x' AS post_text").write.parquet(path)
    posts = spark.read.parquet(path)
    plan = plan_of(predicates.day_window(posts, dt.date(2022, 1, 1)).select("post_id"))
    assert "GreaterThanOrEqual(creation_time" in plan and "LessThanOrEqual(creation_time" in plan
    assert "post_text" not in plan.split("ReadSchema")[1]
    plan = plan_of(predicates.quarter_window(posts, dt.date(2022, 1, 1), "creation_time"))
    assert "GreaterThanOrEqual(creation_time" in plan and "LessThan(creation_time" in plan
    assert "LessThan(post_id,9)" in plan_of(predicates.keyset_page(posts, 5, 9))


def hot_frame(spark, n=60000):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id"))
    return spark.range(0, n, 1, 8).select("id", key.alias("k"))


def test_spread_join_is_the_plain_join(spark, rows, monkeypatch, no_broadcast):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 100)
    left = hot_frame(spark, 3000)
    right = spark.range(0, 3000, 5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(spark.createDataFrame([(7, 1), (7, 2)], "k BIGINT, v BIGINT"))
    for how in ("left", "inner", "left_semi"):
        assert rows(skew.spread_join(left, right, "k", "id", how)) == rows(left.join(right, "k", how))


def test_spread_join_spreads_the_hot_and_the_missing_key(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = hot_frame(spark)
        right = spark.range(1, 100).select(F.col("id").alias("k"), F.lit(1).alias("v")).groupBy("k").agg(F.sum("v").alias("v"))

        def largest(df):
            # The use of v keeps Spark from dropping the join.
            sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("id").alias("n"), F.max("v"))
            counts = [r.n for r in sizes.collect()]
            return max(counts) / sum(counts)

        assert largest(left.join(right, "k", "left")) > 0.4
        assert largest(skew.spread_join(left, right, "k", "id")) < 0.3  # four partitions
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_salts_grow_with_the_key_whatever_the_total(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 100)
    for others in (0, 100_000):
        sizes = {1: 100, 2: 101, 3: 950, 4: 20_000}
        key = [F.when(F.col("id") < sum(sizes[j] for j in sizes if j <= k), k) for k in sizes]
        df = spark.range(sum(sizes.values())).select(F.coalesce(*key).cast("bigint").alias("k"))
        df = df.unionByName(spark.range(10, 10 + others).select(F.col("id").alias("k")))
        assert {r.k: r[skew.SALTS] for r in skew.hot_keys(df, "k").collect()} == {2: 2, 3: 10, 4: 200}


def test_top_k_is_cut_before_the_shuffle_for_any_k(spark):
    from rookery.operators.ranking import top_k

    df = spark.range(10**9).select((F.col("id") % 3).alias("k"), "id")
    sizes = ((1000, 1), (1001, 1), (5, 200), (5, 201))
    assert [optimized(top_k(df, ["k"], [F.col("id").desc()], *size)).count("WindowGroupLimit") for size in sizes] == [1] * 4


@pytest.fixture
def star(spark):
    from rookery.sources.star import StarSource

    return StarSource(spark, "/root/testdata/sf0.001")


def test_boards_have_one_shape_for_any_size(star):
    from rookery.plans import boards, feeds
    from rookery.plans.marts import Marts

    t = star.tables()
    marts = Marts.from_tables(t)
    for board in (feeds.top_of_day, boards.leaderboard):
        sizes = (100, 101, 10_000, 10_001)
        shapes = [re.sub(r"[0-9]+", "", plan_of(board(t, k, marts=marts))) for k in sizes]
        assert len({s.count("hint") + s.count("WindowGroupLimit") for s in shapes}) == 1
        assert all("ResolvedHint" not in plan for plan in (boards.leaderboard(t, k, marts=marts)._jdf.queryExecution().optimizedPlan().toString() for k in sizes))


def test_text_is_fetched_by_post_id_only(star, no_broadcast):
    from rookery.plans import feeds
    from rookery.plans.marts import Marts

    t = star.tables()
    for page in (feeds.home_feed(t, marts=Marts.from_tables(t)), feeds.profile_feed(t, marts=Marts.from_tables(t))):
        plan = page._jdf.queryExecution().executedPlan().toString()
        for node in re.findall(r"(?:Window|WindowGroupLimit) \[.*", plan):
            assert "post_text" not in node
        optimized = page._jdf.queryExecution().optimizedPlan().toString()
        below_rank = optimized.split("Window [row_number")[1:]
        assert below_rank and all("post_text" not in part.split("\n")[0] for part in below_rank)
        assert plan.count("post_text") > 0


def test_marts_sum_votes_once(star, spark, tmp_path):
    from rookery.plans.marts import Marts

    t = star.tables()
    Marts.save(t, str(tmp_path / "m"))
    saved = Marts.load(spark, str(tmp_path / "m"))
    votes = t.post_votes.inputFiles()[0].rsplit("/", 1)[0]
    rest = Marts.from_tables(t, saved.figures)
    for frame in (rest.authors, rest.hot_authors, rest.hot_followed):
        assert all(votes not in f for f in frame.inputFiles())
    whole = Marts.from_tables(t)
    assert sorted(whole.authors.collect()) == sorted(saved.authors.collect())


def test_adaptive_execution_splits_hot_joins_with_plain_tables(spark, tmp_path, no_broadcast):
    from rookery.operators.joins import with_actor

    people = spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("handle"), F.lit("p").alias("profile_photo"))
    notes = spark.range(0, 300000, 1, 8).select(
        F.col("id").alias("notification_id"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 300).alias("triggered_by_user_id"),
        F.md5(F.col("id").cast("string")).alias("x"),
    )
    people.write.parquet(str(tmp_path / "u"))
    notes.write.parquet(str(tmp_path / "n"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = with_actor(spark.read.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "u")))
        shown = df.select(F.xxhash64(*df.columns).alias("h"))
        shown.collect()
        assert "skew=true" in plan_of(shown)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_joins_by_post_need_no_shuffle(spark, social, tmp_path, no_broadcast):
    from rookery.operators import joins
    from rookery.plans import threads
    from rookery.plans.marts import Marts
    from rookery.sources import colocated

    posts = [{"post_id": i, "user_id": i % 5, "camp_id": 0, "is_deleted": 0, "reply_to_id": i - 1 if i % 3 else None, "post_text": f"text {i}"} for i in range(90)]
    votes = [{"camp_id": 0, "user_id": u, "post_id": p, "value": Decimal(1)} for u in range(3) for p in range(0, 90, 2)]
    t = social(users=[{"id": i, "handle": f"u{i}"} for i in range(5)], posts=posts, post_votes=votes)
    marts = Marts.from_tables(t)
    path = str(tmp_path / "by-post")
    colocated.save_by_post(t, marts, "plan_test", path, 4)
    for known in (True, False):
        if not known:  # another application opens the folder
            for table in colocated.TABLES:
                spark.sql(f"DROP TABLE plan_test_{table}")
            colocated.open_by_post(spark, "plan_test", path, 4)
        bucketed, figures = colocated.load_by_post(t, marts, "plan_test")
        joined = joins.with_post_stats(bucketed.post_facts, figures.figures).join(bucketed.posts.select("post_id", "post_text"), "post_id")
        plan = plan_of(joined)
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        assert joined.count() == 90
        # Whole pages shuffle narrow rows to their authors and back, and no text.
        detail = threads.post_detail(bucketed, 1, figures)
        plain = threads.post_detail(t, 1, marts)
        assert detail.exceptAll(plain.select(*detail.columns)).count() == 0 and detail.count() == plain.count() == 90
    for line in plan_of(detail).splitlines():
        if "Exchange hashpartitioning" in line:
            assert "post_text" not in line
    scans = [line for line in plan_of(detail).splitlines() if "post_text" in line and "Scan parquet" in line]
    assert scans and all("Bucketed: true" in line for line in scans)
