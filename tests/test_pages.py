"""Page plans against plain Python over small random networks, with and without salting."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rookery.operators import aggregates
from rookery.plans import boards, camps, feeds, inbox, threads
from rookery.plans.marts import Marts

T0 = dt.datetime(2022, 1, 1)


class Network:
    """A random network in which user 0 is followed by all and writes a third of the posts."""

    def __init__(self, seed, users=30, posts=250, votes=1500):
        rng = random.Random(seed)
        self.users = [
            {"id": u, "handle": f"h{u}", "first_name": f"n{u % 4}", "username": f"n{u % 4}", "profile_photo": None,
             "creation_time": T0 + dt.timedelta(minutes=(u * 7) % users)}
            for u in range(users)
        ]
        self.posts = []
        for p in range(posts):
            parent = rng.randrange(p) if p and rng.random() < 0.5 else None
            self.posts.append(
                {"post_id": p, "camp_id": p % 2, "user_id": 0 if p % 3 == 0 else rng.randrange(users), "reply_to_id": parent,
                 "is_deleted": int(rng.random() < 0.15), "post_text": f"post {p} " + "w" * rng.randrange(500),
                 "creation_time": T0 + dt.timedelta(hours=rng.randrange(400))}
            )
        cast = {}
        for _ in range(votes):
            u, p = rng.randrange(users), rng.choice([0, rng.randrange(posts)])
            cast[u, p] = rng.choice([-1, 0, 1, 1])
        self.votes = [
            {"camp_id": rng.randrange(2), "user_id": u, "post_id": p, "value": v, "added_time": T0} for (u, p), v in cast.items()
        ]
        edges = {(u, 0) for u in range(1, users)} | {(rng.randrange(users), rng.randrange(users)) for _ in range(120)}
        self.edges = {e for e in edges if e[0] != e[1]}
        self.follows = [{"user_id": u, "following": f, "follow_value": 1} for u, f in sorted(self.edges)]
        self.follows += self.follows[:10]  # a table without a unique key can repeat rows
        self.follows += [{"user_id": 1, "following": 29, "follow_value": 0}] if (1, 29) not in self.edges else []

    def tables(self, social):
        votes = [{**v, "value": Decimal(v["value"])} for v in self.votes]
        return social(users=self.users, posts=self.posts, post_votes=votes, follows=self.follows)

    def roots(self):
        return [p for p in self.posts if p["reply_to_id"] is None and not p["is_deleted"]]

    def post_score(self):
        score = defaultdict(int)
        for v in self.votes:
            score[v["post_id"]] += v["value"]
        return score

    def user_score(self):
        by_post, score = self.post_score(), {}
        for p in self.posts:
            if p["post_id"] in by_post:
                score[p["user_id"]] = score.get(p["user_id"], 0) + by_post[p["post_id"]]
        return score

    def top_user(self):
        return min(self.user_score().items(), key=lambda s: (-s[1], s[0]))[0]


@pytest.fixture(params=[1, 2])
def net(request):
    return Network(request.param)


@pytest.fixture(params=["plain", "salted"])
def salting(request, monkeypatch):
    if request.param == "salted":
        monkeypatch.setattr("rookery.operators.skew.ROWS_PER_SALT", 3)


def test_home_feed(net, social, rows, salting):
    t = net.tables(social)
    for cursor in (None, 120):
        expected = {}
        for u in net.users:
            shown = {f for v, f in net.edges if v == u["id"]} | {u["id"]}
            ids = [p["post_id"] for p in net.roots() if p["user_id"] in shown and (cursor is None or p["post_id"] < cursor)]
            for p in sorted(ids, reverse=True)[:5]:
                expected[u["id"], p] = net.posts[p]
        feed = feeds.home_feed(t, cursor=cursor).cache()
        assert rows(feed, "viewer_id", "post_id") == sorted(expected)
        votes = {(v["user_id"], v["post_id"]): v["value"] for v in net.votes}
        scores, authors, best = net.post_score(), net.user_score(), net.top_user()
        children = defaultdict(int)
        for p in net.posts:
            if not p["is_deleted"]:
                children[p["reply_to_id"]] += 1
        for r in feed.collect():
            key = (r.viewer_id, r.post_id)
            assert r.user_id == expected[key]["user_id"] and r.post_text == expected[key]["post_text"]
            assert r.current_user_vote == votes.get(key, 0)
            assert (r.post_score or 0) == scores.get(r.post_id, 0)
            assert r.user_score == authors.get(r.user_id)
            assert (r.reply_count or 0) == children[r.post_id]
            assert (r.up_votes or 0) == sum(v["value"] > 0 for v in net.votes if v["post_id"] == r.post_id)
            assert r.is_top_user == (r.user_id == best)
        feed.unpersist()


def test_later_pages_follow_each_viewers_cursor(net, social, rows, salting):
    t = net.tables(social)
    expected = []
    for u in net.users:
        shown = {f for v, f in net.edges if v == u["id"]} | {u["id"]}
        ids = sorted((p["post_id"] for p in net.roots() if p["user_id"] in shown), reverse=True)
        expected += [(u["id"], p) for p in ids[6:9]]
    assert rows(feeds.home_feed(t, k=3, page=3), "viewer_id", "post_id") == sorted(expected)


def test_home_feed_of_some_viewers_is_the_same_rows(net, social, spark, rows):
    t = net.tables(social)
    some = spark.createDataFrame([(3,), (8,)], "viewer_id BIGINT")
    whole = feeds.home_feed(t).filter(F.col("viewer_id").isin(3, 8))
    columns = ["viewer_id", "post_id", "current_user_vote", "post_score", "user_score", "post_text"]
    assert rows(feeds.home_feed(t, viewers=some), *columns) == rows(whole, *columns)


def test_one_thread_is_the_same_rows(net, social, spark, rows):
    t = net.tables(social)
    some = spark.createDataFrame([(0,), (5,), (9,)], "post_id BIGINT")
    columns = ["thread_id", "level", "post_id", "net_votes", "handle", "user_score", "post_text"]
    whole = threads.thread(t, viewer_id=8).filter(F.col("thread_id").isin(0, 5, 9))
    assert rows(threads.thread(t, viewer_id=8, heads=some), *columns) == rows(whole, *columns)


def test_profile_feed_and_format(net, social, rows, salting):
    t = net.tables(social)
    expected = []
    for u in range(len(net.users)):
        mine = sorted((p["post_id"] for p in net.roots() if p["user_id"] == u), reverse=True)
        expected += [(u, p) for p in mine[:10]]
    feed = feeds.profile_feed(t, viewer_id=8)
    assert rows(feed, "user_id", "post_id") == sorted(expected)
    shown = {r.post_id: r for r in feeds.format_feed(feed, T0 + dt.timedelta(days=40)).collect()}
    votes = {v["post_id"]: v["value"] for v in net.votes if v["user_id"] == 8}
    for _, p in expected:
        text = net.posts[p]["post_text"]
        assert shown[p].post_length == len(text) and shown[p].post_length_flag == int(len(text) > 400)
        assert (shown[p].post_text == text) == (len(text) <= 400)
        assert shown[p].current_user_vote == votes.get(p, 0)
        assert shown[p].profile_photo == "no_image.jpg"


def test_top_of_day(net, social, rows):
    t = net.tables(social)
    scores, voted = net.post_score(), {v["post_id"] for v in net.votes}
    by_day = defaultdict(list)
    for p in net.roots():
        by_day[(p["creation_time"] - dt.timedelta(hours=5)).date()].append(p["post_id"])
    expected = []
    for day, ids in by_day.items():
        ids.sort(key=lambda p: (p not in voted, -scores.get(p, 0), -p))
        expected += [(day, p) for p in ids[:3]]
    assert rows(feeds.top_of_day(t, k=3), "day", "post_id") == sorted(expected)
    days = sorted(by_day, reverse=True)
    assert [(r.day, r.day_offset) for r in feeds.active_days(t.posts).orderBy("day_offset").collect()] == [
        (d, i) for i, d in enumerate(days)
    ]
    assert [r.day for r in feeds.nth_active_day(t.posts, 4).collect()] == [days[4]]


def test_threads(net, social, rows, salting):
    t = net.tables(social)
    live = {p["post_id"]: p for p in net.posts if not p["is_deleted"]}
    expected = []
    for h in live:
        first = [p for p in live if live[p]["reply_to_id"] == h]
        second = [p for p in live if live[p]["reply_to_id"] in first]
        expected += [(h, 0, h)] + [(h, 1, p) for p in first] + [(h, 2, p) for p in second]
    pages = threads.thread(t, viewer_id=8)
    assert rows(pages, "thread_id", "level", "post_id") == sorted(expected)
    net_votes = net.post_score()
    ordered = threads.in_page_order(pages.select("thread_id", "level", "net_votes", "post_id")).collect()
    keys = [(r.thread_id, r.level, -net_votes.get(r.post_id, 0), r.post_id) for r in ordered]
    assert keys == sorted(keys)


def test_post_detail_has_every_live_post(net, social, rows, salting):
    t = net.tables(social)
    detail = threads.post_detail(t, viewer_id=8)
    scores, authors = net.post_score(), net.user_score()
    expected = [
        (p["post_id"], p["user_id"], f"h{p['user_id']}", scores.get(p["post_id"], 0), authors.get(p["user_id"], 0))
        for p in net.posts
        if not p["is_deleted"]
    ]
    assert rows(detail, "post_id", "user_id", "handle", "net_votes", "user_score") == sorted(expected)


def test_score_invariants(net, social):
    t = net.tables(social)
    posts = aggregates.post_score(t.post_votes).agg(F.sum("post_score")).first()[0]
    users = aggregates.user_score(t.users, t.posts, t.post_votes).agg(F.sum("user_score")).first()[0]
    net_total = aggregates.net_votes(aggregates.vote_counts(t.post_votes)).agg(F.sum("net_votes")).first()[0]
    assert posts == users == net_total == sum(v["value"] for v in net.votes)


def test_leaderboard_and_search(net, social, tmp_path, spark):
    t = net.tables(social)
    Marts.save(t, str(tmp_path / "marts"))
    scores = net.user_score()
    ranked = sorted(range(len(net.users)), key=lambda u: (u not in scores, -scores.get(u, 0), u))
    for marts in (None, Marts.load(spark, str(tmp_path / "marts"))):
        board = boards.leaderboard(t, k=7, viewer_id=1, marts=marts).collect()
        assert [(r.place, r.id) for r in board] == list(enumerate(ranked[:7], 1))
        assert all(r.follow_value == int((1, r.id) in net.edges) for r in board)
        assert [r.id for r in board if r.is_top_user] == [net.top_user()]
        found = boards.people_search(t, "N2", k=4, viewer_id=1, marts=marts).collect()
        oldest = sorted((u for u in net.users if u["first_name"] == "n2"), key=lambda u: (u["creation_time"], u["id"]))
        assert [r.id for r in found] == [u["id"] for u in oldest[:4]]


def test_unvoted_users_come_after_negative_scores(social):
    users = [{"id": i, "handle": f"u{i}", "first_name": "n"} for i in range(4)]
    posts = [{"post_id": i, "user_id": i, "is_deleted": 0} for i in range(4)]
    votes = [{"user_id": 9, "post_id": 0, "value": Decimal(-1)}] + [{"user_id": v, "post_id": 2, "value": Decimal(1)} for v in range(5)]
    t = social(users=users, posts=posts, post_votes=votes, follows=[])
    board = boards.leaderboard(t).collect()
    assert [(r.place, r.id, r.user_score) for r in board] == [(1, 2, 5), (2, 0, -1), (3, 1, 0), (4, 3, 0)]


def test_each_viewers_cursor_repeats_nothing_when_posts_arrive(net, social, spark, rows, salting, monkeypatch):
    monkeypatch.setattr(feeds, "BLOCK", 4)
    t = net.tables(social)
    first = feeds.home_feed(t, k=3).select("viewer_id", "post_id").collect()
    cursors = {}
    for r in first:
        cursors[r.viewer_id] = min(r.post_id, cursors.get(r.viewer_id, r.post_id))
    late = [{**net.posts[net.roots()[0]["post_id"]], "post_id": 1_000_000 + u["id"], "user_id": u["id"], "reply_to_id": None, "is_deleted": 0} for u in net.users]
    grown = t.with_frames(posts=t.posts.unionByName(social(posts=late).posts))
    given = spark.createDataFrame(list(cursors.items()), "viewer_id BIGINT, cursor BIGINT")
    expected = []
    for u in net.users:
        shown = {f for v, f in net.edges if v == u["id"]} | {u["id"]}
        ids = sorted((p["post_id"] for p in [*net.roots(), *late] if p["user_id"] in shown), reverse=True)
        expected += [(u["id"], p) for p in [i for i in ids if i < cursors.get(u["id"], 10**9)][:3]]
    got = rows(feeds.home_feed(grown, k=3, cursor=given), "viewer_id", "post_id")
    assert got == sorted(expected) and not {(r.viewer_id, r.post_id) for r in first} & set(got)


def test_camp_wall(net, social, rows, salting):
    t = net.tables(social)
    camp = [p for p in net.posts if p["camp_id"] == 1]
    score = {}
    for v in net.votes:
        if v["camp_id"] == 1:
            score[v["post_id"]] = score.get(v["post_id"], 0) + v["value"]
    names = defaultdict(int)
    for u, s in net.user_score().items():
        names[f"n{u % 4}"] += s
    expected = [(p["post_id"], score.get(p["post_id"]), names[f"n{p['user_id'] % 4}"]) for p in camp]
    got = camps.camp_wall(t, 1).select("post_id", "post_score", "user_score").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == sorted(expected)


def test_daily_active_users(spark, rows):
    votes = spark.createDataFrame(
        [(1, dt.datetime(2022, 3, 31, 23)), (1, dt.datetime(2022, 4, 1)), (2, dt.datetime(2022, 4, 1, 5))],
        "user_id BIGINT, added_time TIMESTAMP_NTZ",
    )
    posts = spark.createDataFrame(
        [(1, dt.datetime(2022, 4, 1, 9)), (3, dt.datetime(2022, 6, 30, 23)), (3, dt.datetime(2022, 7, 1))],
        "user_id BIGINT, creation_time TIMESTAMP_NTZ",
    )
    got = aggregates.daily_active_users(votes, posts, dt.date(2022, 5, 5))
    assert rows(got) == [(dt.date(2022, 4, 1), 2), (dt.date(2022, 6, 30), 1)]
    assert rows(aggregates.daily_active_users(votes, posts, dt.date(2022, 5, 5), approximate=True)) == rows(got)


def test_inbox(social, rows):
    notes = [
        {"notification_id": i, "user_id": 1, "triggered_by_user_id": 2, "event_type_id": 2, "reference_post_id": i,
         "seen": int(i >= 5), "creation_time": T0 + dt.timedelta(minutes=i)}
        for i in range(30)
    ]
    t = social(users=[{"id": 2, "handle": "bob"}], notifications=notes)
    shown = inbox.notification_inbox(t, T0 + dt.timedelta(hours=1))
    assert rows(shown, "notification_id") == [(i,) for i in range(5, 30)]
    newest = shown.filter("notification_id = 29").first()
    assert (newest.text, newest.redirect, newest.time_ago) == ("replied to your post", "/post/29", "31min")
    assert (newest.handle, newest.profile_photo) == ("bob", "no_image.jpg")
    # The five unseen ones are older than the 25 shown.
    assert rows(aggregates.unseen_count(t.notifications)) == [(1, 0)]
    assert rows(aggregates.unseen_count(t.notifications, k=None)) == [(1, 5)]


def test_empty_tables(social):
    t = social()
    for df in (feeds.home_feed(t), feeds.profile_feed(t), feeds.top_of_day(t), threads.thread(t), boards.leaderboard(t)):
        assert df.count() == 0
    assert aggregates.latest_post_id(t.posts).first().cursor == 1
