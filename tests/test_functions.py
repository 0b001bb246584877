import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rookery import functions as fn

NOW = dt.datetime(2024, 3, 10, 12, 0, 0)


def one_column(spark, values, kind, expr):
    df = spark.createDataFrame(list(enumerate(values)), f"i INT, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_levels_and_bars(spark):
    scores = [12, 0, -3, None, 9, 10, -10, 199]
    assert one_column(spark, scores, "BIGINT", fn.level) == [1, 0, 0, 0, 0, 1, -1, 19]
    assert one_column(spark, scores, "BIGINT", fn.score_bars) == [2, 0, 7, 0, 9, 0, 0, 9]
    assert one_column(spark, [0, 3, 9], "BIGINT", fn.score_bar_text) == ["⬜" * 10, "⬛" * 3 + "⬜" * 7, "⬛" * 9 + "⬜"]


def test_blank_zero(spark):
    assert one_column(spark, [0, None, 4], "BIGINT", fn.blank_zero) == [" ", " ", "4"]


AGES = {
    0: "just now",
    9: "just now",
    10: "10sec",
    59: "59sec",
    60: "1min",
    3599: "59min",
    3600: "1hr",
    86399: "23hr",
    86400: "1d",
    2 * 86400: "2d",
    6 * 86400: "6d",
    7 * 86400: "1w",
    30 * 86400: "4w",
    31 * 86400: "1mo",
    364 * 86400: "12mo",
    365 * 86400: "1y",
    800 * 86400: "2y",
    # The future keeps to the seconds within a day.
    -5: "23hr",
    -86395: "just now",
    -86400 * 3: "just now",
}


def test_time_ago(spark):
    times = [NOW - dt.timedelta(seconds=s) for s in AGES]
    got = one_column(spark, times, "TIMESTAMP_NTZ", lambda c: fn.time_ago(c, NOW))
    assert got == list(AGES.values())


def expected_age(seconds):
    gap = dt.timedelta(seconds=seconds)
    if gap.days <= 0:
        s = gap.seconds
        return "just now" if s < 10 else f"{s}sec" if s < 60 else f"{s // 60}min" if s < 3600 else f"{s // 3600}hr"
    d = gap.days
    return f"{d}d" if d < 7 else f"{d // 7}w" if d < 31 else f"{d // 30}mo" if d < 365 else f"{d // 365}y"


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Europe/Berlin"])
def test_time_ago_on_random_ages_in_any_zone(spark, zone):
    rng = random.Random(4)
    ages = [rng.uniform(-3 * 86400, 3 * 365 * 86400) for _ in range(300)]
    ages = [round(a, 6) for a in ages]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        times = [NOW - dt.timedelta(seconds=a) for a in ages]
        got = one_column(spark, times, "TIMESTAMP_NTZ", lambda c: fn.time_ago(c, NOW))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [expected_age((NOW - t).total_seconds()) for t in times]


def shortened(text):
    if len(text) <= 400:
        return text
    end = min(450, len(text))
    space = text.find(" ", 400, 450)
    return text[: space if space >= 0 else end] + "..."


def test_truncate_post(spark):
    rng = random.Random(7)
    texts = ["a" * n for n in (0, 399, 400, 401, 449, 450, 451, 600)]
    texts += ["a" * p + " " + "b" * 300 for p in (399, 400, 401, 449, 450)]
    texts += ["".join(rng.choice("ab é⬛ ") for _ in range(rng.randint(380, 520))) for _ in range(200)]
    assert one_column(spark, texts, "STRING", fn.truncate_post) == [shortened(t) for t in texts]
    assert one_column(spark, texts, "STRING", fn.is_long_post) == [len(t) > 400 for t in texts]


def test_mentions_and_links(spark):
    texts = ["hi @Ann_1, see @bob and @bob!", "mail me a@b.c", "none", "@", None]
    assert one_column(spark, texts, "STRING", fn.extract_mentions)[:4] == [["Ann_1", "bob", "bob"], ["b"], [], []]
    links = one_column(spark, texts, "STRING", fn.linkify)
    assert links[0] == 'hi <a href="/@Ann_1">@Ann_1</a>, see <a href="/@bob">@bob</a> and <a href="/@bob">@bob</a>!'
    assert links[2:] == ["none", "@", None]


def test_photo_dates_and_days(spark):
    assert one_column(spark, [None, "", "x.png"], "STRING", fn.default_photo) == ["no_image.jpg", "no_image.jpg", "x.png"]
    times = [dt.datetime(2022, 1, 1, 4, 59, 59), dt.datetime(2022, 1, 1, 5)]
    assert one_column(spark, times, "TIMESTAMP_NTZ", fn.local_day) == [dt.date(2021, 12, 31), dt.date(2022, 1, 1)]
    assert one_column(spark, times, "TIMESTAMP_NTZ", fn.display_date) == ["01-01-2022"] * 2
    assert one_column(spark, times, "TIMESTAMP_NTZ", fn.display_day) == ["12-31", "01-01"]


def test_notification_wording(spark):
    df = spark.createDataFrame(
        [(1, "ann", None), (2, "ann", 5), (3, "ann", 6), (2, "ann", None), (9, "ann", 1)],
        "k INT, handle STRING, post BIGINT",
    )
    got = df.select(
        fn.notification_text(F.col("k")), fn.notification_link(F.col("k"), F.col("handle"), F.col("post"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("now follows you", "/@ann"),
        ("replied to your post", "/post/5"),
        ("mentioned you", "/post/6"),
        ("replied to your post", "/post/0"),
        ("", ""),
    ]


def test_vote_flags(spark):
    votes = [-2, -1, 0, 1, 2, None]
    assert one_column(spark, votes, "BIGINT", fn.voted_up) == [False, False, False, True, True, False]
    assert one_column(spark, votes, "BIGINT", fn.voted_down) == [True, True, False, False, False, False]
    assert one_column(spark, votes, "BIGINT", lambda c: fn.is_own(c, F.lit(1)))[3:] == [True, False, False]
