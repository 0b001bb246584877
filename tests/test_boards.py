import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rookery.operators import predicates, prefilter
from rookery.operators.boards import KeptBoards

ROWS = "day STRING, id BIGINT, score BIGINT"


def ranked(scores, k, lower_id_first):
    best = {}
    for i, (day, score) in scores.items():
        best.setdefault(day, []).append((score is None, -(score or 0), i if lower_id_first else -i, i, score))
    return sorted((day, n + 1, r[3], r[4]) for day, rows in best.items() for n, r in enumerate(sorted(rows)[:k]))


@pytest.mark.parametrize("lower_id_first", [True, False])
def test_kept_boards_equal_the_whole_ranking(spark, tmp_path, lower_id_first):
    rng = random.Random(9)
    scores = {i: (f"d{i % 4}", rng.choice([None, *range(-3, 6)])) for i in range(120)}
    frame = lambda some: spark.createDataFrame([(d, i, s) for i, (d, s) in some.items()], ROWS)
    board = KeptBoards(spark, str(tmp_path), ["day"], 3, lower_id_first)
    board.create(frame(scores))
    anew = []
    for n in range(8):
        if n == 4:  # the best lose their votes, so that a list runs short
            leaders = [r.id for r in spark.read.parquet(f"{tmp_path}/rows/version={n}").filter("day = 'd1'").collect()]
            changed = {i: ("d1", -50) for i in leaders}
        else:
            changed = {i: (scores[i][0], (scores[i][1] or 0) + rng.choice([-2, -1, 1, 2])) for i in rng.sample(sorted(scores), 12)}
        changed[1000 + n] = ("d9" if n > 2 else "d0", rng.randrange(9))
        lost = rng.sample(sorted(set(scores) - set(changed)), 2) if n % 2 else []
        gone = frame({i: scores.pop(i) for i in lost}) if lost else None
        scores |= changed
        anew.append(board.update(frame(changed), lambda: frame(scores), gone=gone))
        got = sorted((r.day, r.place, r.id, r.score) for r in board.shown().collect())
        assert got == ranked(scores, 3, lower_id_first), n
    assert anew[4] == 1 and sum(anew) <= 3
    # A version that is there already is left as it is.
    assert board.update(frame({5: ("d1", 99)}), lambda: frame(scores), version=board.versions()[-1]) == 0
    assert sorted((r.day, r.place, r.id, r.score) for r in board.shown().collect()) == got


def test_a_single_list(spark, tmp_path):
    board = KeptBoards(spark, str(tmp_path), [], 2)
    board.create(spark.createDataFrame([(i, None) for i in range(50)], "id BIGINT, score BIGINT"))
    assert [(r.place, r.id) for r in board.shown().orderBy("place").collect()] == [(1, 49), (2, 48)]
    board.update(spark.createDataFrame([(7, 3), (8, -1)], "id BIGINT, score BIGINT"), lambda: 1 / 0)
    assert [(r.place, r.id, r.score) for r in board.shown().orderBy("place").collect()] == [(1, 7, 3), (2, 8, -1)]  # no score is below any score


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_without_a_partner_are_not_shuffled(spark, tmp_path, no_broadcast):
    votes = spark.range(200_000).selectExpr("id % 50000 AS post_id", "id AS user_id")
    ids = spark.range(50_000).filter("id % 25 = 0").selectExpr("CAST(id AS INT) AS post_id")
    expected = votes.filter("post_id % 25 = 0")
    got = predicates.restrict_ids(votes, ids, "post_id", "user_id", bitmap=True)
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()
    # The bitmap stands between the scan and every shuffle of the votes, and lets few others pass.
    passed = prefilter.restrict_by_bitmap(votes, ids, "post_id")
    assert "Exchange hashpartitioning(post_id" not in passed._jdf.queryExecution().executedPlan().toString()
    assert expected.count() <= passed.count() < 2.5 * expected.count()
    bits = 1 << 15
    known = ids.select(F.col("post_id").cast("bigint").alias("post_id"))
    assert prefilter.may_match(votes, "post_id", prefilter.id_bitmap(known, "post_id", bits), bits).join(known, "post_id", "left_semi").count() == expected.count()


def test_long_and_empty_lists_and_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "post_id BIGINT, user_id STRING")
    ids = spark.createDataFrame([(3,), (None,), (3,)], "post_id BIGINT")
    assert [tuple(r) for r in predicates.restrict_ids(rows, ids, "post_id", "user_id", bitmap=True).collect()] == [(3, "c")]
    assert predicates.restrict_ids(rows, ids.limit(0), "post_id", "user_id", bitmap=True).count() == 0
    # Beyond the largest bitmap all rows go on to the join.
    assert prefilter.restrict_by_bitmap(rows, ids, "post_id", most_bits=1) is rows
