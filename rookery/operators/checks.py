"""Checks of sign-up requests and reset tokens."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours, ntz
from .skew import spread_join

# Fixed values of the sign-up form.
MAX_NAME = 25
HANDLE_FORM = "^[A-Za-z0-9_]+$"
EMAIL_FORM = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
TOKEN_LIFE_HOURS = 24


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) == ""


def check_registrations(requests: DataFrame) -> DataFrame:
    """Add `errors`, the failed rules of each request. A missing field reports only that."""

    def rule(column: str, fails: Column, name: str) -> Column:
        return F.when(~_blank(column) & fails, F.lit(name))

    def required(column: str, name: str) -> Column:
        return F.when(_blank(column), F.lit(name))

    rules = [
        required("email", "email_required"),
        rule("email", ~F.col("email").rlike(EMAIL_FORM), "email_form"),
        required("name", "name_required"),
        rule("name", F.length("name") > MAX_NAME, "name_length"),
        required("username", "username_required"),
        rule("username", F.length("username") > MAX_NAME, "username_length"),
        rule("username", ~F.col("username").rlike(HANDLE_FORM), "username_form"),
    ]
    return requests.withColumn("errors", F.array_compact(F.array(*rules)))


def reject_taken_accounts(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Add `status` to each request (request_id, request_time, email, username).

    accepted     the first of the batch for its email and for its username, both free
    email_taken  a user or an accepted request has the email (tested before the username)
    handle_taken likewise for the username
    deferred     only lost to a request that was itself not accepted: submit it again
    Emails and usernames compare without case.
    """
    asked = requests.withColumn("_email", F.lower("email")).withColumn("_handle", F.lower("username"))
    emails = users.select(F.lower("email").alias("_email")).distinct().withColumn("_email_used", F.lit(1))
    handles = users.select(F.lower("handle").alias("_handle")).distinct().withColumn("_handle_used", F.lit(1))
    by_email = spread_join(asked, emails, "_email", "request_id")
    checked = spread_join(by_email, handles, "_handle", "request_id", counted=asked)

    # Minimum per key instead of a window: it is combined before the shuffle, so an email
    # asked for by a third of the batch is no hot group. The first request for an email is
    # accepted when it is also the first for its username; both sides of that test are small.
    place = F.struct("request_time", "request_id")
    open_requests = checked.filter(F.col("_email_used").isNull() & F.col("_handle_used").isNull())
    first_email = open_requests.groupBy("_email").agg(F.min(F.struct(place.alias("place"), "_handle")).alias("_e"))
    first_handle = open_requests.groupBy("_handle").agg(F.min(F.struct(place.alias("place"), "_email")).alias("_h"))
    accepted = (
        first_email.select("_email", "_e.place", "_e._handle")
        .join(first_handle.select("_handle", "_h.place"), ["_handle", "place"])
    )
    won_email = accepted.select("_email", F.col("place").alias("_email_won"))
    won_handle = accepted.select("_handle", F.lit(1).alias("_handle_won"))
    status = (
        F.when(F.col("_email_used").isNotNull(), "email_taken")
        .when(F.col("_handle_used").isNull() & (F.col("_email_won") == place), "accepted")
        .when(F.col("_email_won") < place, "email_taken")
        .when(F.col("_handle_used").isNotNull() | F.col("_handle_won").isNotNull(), "handle_taken")
        .otherwise("deferred")
    )
    return (
        checked.join(won_email, "_email", "left")
        .join(won_handle, "_handle", "left")
        .withColumn("status", status)
        .select(*requests.columns, "status")
    )


def token_status(tokens: DataFrame, as_of: str | dt.datetime) -> DataFrame:
    """expired after 24 hours, else used or valid; a missing `used` counts as unused."""
    status = (
        F.when(F.col("creation_time") + hours(TOKEN_LIFE_HOURS) < ntz(as_of), "expired")
        .when(F.coalesce("used", F.lit(0)) > 0, "used")
        .otherwise("valid")
    )
    return tokens.withColumn("status", status)
