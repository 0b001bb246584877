import datetime as dt
import random

from rookery.operators import predicates, search, sketches

T0 = dt.datetime(2022, 1, 1)
USERS = "id BIGINT, handle STRING, first_name STRING, creation_time TIMESTAMP_NTZ"
TERMS = ["", "%", "_", "____", "a", "AB", "abc", "a%c", "a_c", "_b_", "ab%", "%%", "x\\%y", "x\\_y", "x%y", "\\abc", "b\\\\c", "ΟΔΟΣ", "Σ", "é", "İ", "no such", "a b", ".*", "(", "abc%bca%c", "bc\\", "\U0001f642"]


def some_users(spark, rng):
    letters = ["a", "b", "c", "A", "C", "_", " ", "%", "x", "y", "é", "Σ", "ο", "\\", "İ", ".", "\U0001f642"]
    names = [("x%y", "x_y"), ("XaY", None), (None, "ΟΔΟΣ"), ("οδοσ", "οδος"), ("b\\c", "(.*)"), ("", ""), ("a b", "No Such")]
    names += [tuple("".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(2)) for _ in range(250)]
    return spark.createDataFrame([(i, *n, T0 + dt.timedelta(days=rng.randrange(30))) for i, n in enumerate(names)], USERS)


def index_of(spark, users, path):
    search.save_name_index(users, path)
    return search.load_name_index(spark, path)


def test_indexed_search_equals_search_term_by_term(spark, rows, tmp_path):
    rng = random.Random(3)
    users = some_users(spark, rng)
    terms = TERMS + ["".join(rng.choice("abcAC_%x ") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    frame = spark.createDataFrame([(t,) for t in terms + terms[:5]], "term STRING")
    index = index_of(spark, users, str(tmp_path / "index"))
    for k in (50, 3):
        got = rows(search.search_users_indexed(users, frame, index, k), "term", "id")
        assert got == rows(predicates.search_users_many(users, terms, k), "term", "id")
    everything = rows(search.search_users_indexed(users, frame, index, None), "term", "id")
    assert everything == rows(predicates.search_users_many(users, terms, 10_000), "term", "id")


def test_only_users_with_the_rarest_gram_are_compared(spark, tmp_path):
    users = spark.createDataFrame([(i, f"member_{i:04d}", "person", T0) for i in range(2000)], USERS)
    grams, counts = index_of(spark, users, str(tmp_path / "index"))
    assert counts.filter("gram = 'mem'").first().n == 2000
    terms = spark.createDataFrame([("member_0123",), ("_12",), ("zzz",)], "term STRING")
    found = search.search_users_indexed(users, terms, (grams, counts))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(tuple(r) for r in found.select("term", "id").collect()) == sorted(
        [("member_0123", 123)] + [("_12", i) for i in sorted(range(2000), key=lambda i: i) if "12" in f"{i:04d}"[0:4] or f"{i:04d}".startswith("12")][:50]
    )


def test_plan_does_not_grow_with_the_terms(spark, tmp_path):
    users = some_users(spark, random.Random(1))
    index = index_of(spark, users, str(tmp_path / "index"))
    lengths = set()
    for n in (10, 3000):
        terms = spark.range(n).selectExpr("CAST(id AS STRING) AS term")
        lengths.add(len(search.search_users_indexed(users, terms, index)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert len(lengths) == 1
    assert search.search_users_indexed(users, terms.limit(0), index).count() == 0


def test_sketches_of_days_merge_to_any_period(spark, rows, tmp_path):
    acts = spark.createDataFrame(
        [(u, T0 + dt.timedelta(days=d, hours=u % 24)) for d in range(100) for u in range(d, d + 40)], "user_id BIGINT, time TIMESTAMP_NTZ"
    )
    sketches.daily_sketches(acts.filter("user_id % 2 = 0")).write.parquet(str(tmp_path / "s"))
    sketches.daily_sketches(acts.filter("user_id % 2 = 1")).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert stored.count() == 200
    days = rows(sketches.active_users(stored))
    assert len(days) == 100 and all(n == 40 for _, n in days)
    quarters = dict(rows(sketches.active_users(stored, "quarter")))
    assert abs(quarters[dt.date(2022, 1, 1)] - 129) <= 129 * 4 * sketches.STANDARD_ERROR
    weeks = rows(sketches.active_users(stored, "week"))
    assert weeks[1][0] == dt.date(2022, 1, 3) and weeks[1][1] == 46
    assert sketches.active_users(stored.limit(0), "year").count() == 0


def test_sketch_error_on_many_users(spark):
    acts = spark.range(200_000).selectExpr("id AS user_id", "TIMESTAMP_NTZ'2022-01-05 10:00:00' AS time")
    found = sketches.active_users(sketches.daily_sketches(acts)).first().active_users
    assert abs(found - 200_000) <= 4 * sketches.STANDARD_ERROR * 200_000
