"""Shared helpers: tables written on the way, and bitmaps that tell most rows from those that an exact join has to decide."""

import os

from rookery.llm import common


def test_marks_miss_no_key_and_grow_with_the_keys(spark, monkeypatch):
    keys = spark.range(0, 100_000, 10).selectExpr("CAST(id AS STRING) AS k")
    rows = spark.range(100_000).selectExpr("id", "CAST(id AS STRING) AS k", "'x' AS map", "'y' AS bits")
    known = common.marks(spark, keys)
    found = common.marked(rows, "k", known)
    assert known.bits == common.LEAST_MARKS and found.columns == [*rows.columns, "__marked"]
    assert found.where("id % 10 = 0 AND NOT __marked").count() == 0
    assert found.where("id % 10 <> 0 AND __marked").count() < 900
    monkeypatch.setattr(common, "LEAST_MARKS", 1 << 15)
    assert common.marks(spark, keys).bits == 1 << 18
    # Beyond the largest size more rows are marked, and still no key is missed.
    monkeypatch.setattr(common, "MOST_MARKS", 1 << 15)
    full = common.marks(spark, keys)
    assert full.bits == 1 << 15 and common.marked(rows, "k", full).where("id % 10 = 0 AND NOT __marked").count() == 0
    none = common.marked(rows, "k", common.marks(spark, keys.limit(0)))
    assert none.where("__marked").count() == 0


def test_only_the_result_of_a_step_stays(spark):
    made = []

    def make():
        first = common.stored(spark, spark.range(5), "one")
        made.extend(first.inputFiles())
        return common.stored(spark, first.where("id > 1"), "two").where("id > 2")

    found = common.settled(spark, make, "result")
    assert sorted(r.id for r in found.collect()) == [3, 4]
    assert not any(os.path.exists(f.removeprefix("file://")) for f in made)
    kept = common.stored(spark, spark.range(3), "later")
    assert kept.count() == 3
