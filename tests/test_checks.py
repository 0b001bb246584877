import datetime as dt
import random

from rookery.operators import checks

REQUESTS = "request_id BIGINT, request_time TIMESTAMP_NTZ, email STRING, name STRING, username STRING"
T0 = dt.datetime(2024, 1, 1)


def test_check_registrations(spark):
    data = [
        ("a@b.co", "Ann", "ann_1", []),
        ("", "Ann", "ann", ["email_required"]),
        ("no address", "Ann", "ann", ["email_form"]),
        ("a@b.co", "  ", "ann", ["name_required"]),
        ("a@b.co", "n" * 25, "h" * 25, []),
        ("a@b.co", "n" * 26, "h" * 26, ["name_length", "username_length"]),
        ("a@b.co", "Ann", "two words", ["username_form"]),
        ("a@b.co", "Ann", None, ["username_required"]),
        ("a@b.co", "Ann", "!" * 26, ["username_length", "username_form"]),
    ]
    df = spark.createDataFrame([(i, T0, *d[:3]) for i, d in enumerate(data)], REQUESTS)
    got = [r.errors for r in checks.check_registrations(df).orderBy("request_id").collect()]
    assert got == [d[3] for d in data]


USERS = "id BIGINT, email STRING, handle STRING"


def statuses(spark, users, requests):
    u = spark.createDataFrame(users, USERS) if users else spark.createDataFrame([], USERS)
    r = spark.createDataFrame(
        [(i, T0 + dt.timedelta(seconds=i), e, "n", h) for i, (e, h) in enumerate(requests)], REQUESTS
    )
    return [x.status for x in checks.reject_taken_accounts(r, u).orderBy("request_id").collect()]


def test_taken_accounts(spark):
    got = statuses(
        spark,
        [(1, "Ann@x.co", "Ann")],
        [
            ("ann@X.co", "new"),  # email of a user
            ("b@x.co", "ANN"),  # handle of a user
            ("c@x.co", "cee"),
            ("c@x.co", "dee"),  # email of an accepted request
            ("e@x.co", "CEE"),  # handle of an accepted request
            ("e@x.co", "eve"),  # lost only to the rejected one above
        ],
    )
    assert got == ["email_taken", "handle_taken", "accepted", "email_taken", "handle_taken", "deferred"]


def one_by_one(users, requests):
    """What the sign-up form answers when the requests come in one after the other."""
    emails, handles = {u[1].lower() for u in users}, {u[2].lower() for u in users}
    out = []
    for e, h in requests:
        if e.lower() in emails:
            out.append("email_taken")
        elif h.lower() in handles:
            out.append("handle_taken")
        else:
            out.append("accepted")
            emails.add(e.lower())
            handles.add(h.lower())
    return out


def test_deferred_requests_settle_to_the_sequential_answer(spark, monkeypatch):
    monkeypatch.setattr("rookery.operators.skew.ROWS_PER_SALT", 3)
    rng = random.Random(3)
    users = [(i, f"u{i}@x.co", f"h{i}") for i in range(5)]
    requests = [(f"u{rng.randint(0, 30)}@x.co", f"H{rng.randint(0, 30)}") for _ in range(60)]
    expected = one_by_one(users, requests)
    got = {}
    known, waiting = list(users), list(range(len(requests)))
    for _ in range(60):
        answers = statuses(spark, known, [requests[i] for i in waiting])
        settled = [(i, a) for i, a in zip(waiting, answers) if a != "deferred"]
        got.update(settled)
        known += [(100 + i, requests[i][0], requests[i][1]) for i, a in settled if a == "accepted"]
        waiting = [i for i in waiting if i not in got]
        if not waiting:
            break
    accepted = {i for i, a in enumerate(expected) if a == "accepted"}
    assert {i for i, a in got.items() if a == "accepted"} == accepted


def test_token_status(spark, rows):
    as_of = dt.datetime(2024, 1, 15)
    ages = [("valid", 23, 59, None), ("expired", 24, 1, None), ("used", 1, 0, 1), ("valid", 24, 0, 0), ("expired", 25, 0, 1)]
    df = spark.createDataFrame(
        [(i, as_of - dt.timedelta(hours=h, minutes=m), used) for i, (_, h, m, used) in enumerate(ages)],
        "token_id BIGINT, creation_time TIMESTAMP_NTZ, used INT",
    )
    got = checks.token_status(df, as_of)
    assert [s for _, s in rows(got, "token_id", "status")] == [a[0] for a in ages]
