"""Social tables derived from star-schema test files.

customer gives users, orders gives posts (text from documents), lineitem gives votes and
follows, events gives notifications, tokens and sign-up requests. Every derived table uses
the whole of its source table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ntz
from ..operators.changes import normalise_votes, reject_self_votes
from ..operators.ranking import latest_by_key
from ..session import folder_state, written_table
from .schemas import STAR
from .tables import LateText, SocialTables

# Line items of one order and supplier can share a date and even a line number.
TIE_BREAK = ("line_number", "part_id", "price")


_VALUES: dict[tuple[str, ...], object] = {}


@dataclass(frozen=True)
class StarSource:
    """Frames are built once per session and path, and shared by all queries on them."""

    spark: SparkSession
    path: str

    @cache
    def state(self) -> str:
        """The folder and what lies in it, to which everything written for it belongs."""
        return f"{self.path} {folder_state(self.spark, self.path)}"

    @cache
    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(STAR[name]).parquet(f"{self.path}/{name}.parquet")

    def _value(self, name: str, value: Column):
        """One number of a source file, read once per application."""
        key = (self.spark.sparkContext.applicationId, self.state(), name, str(value))
        if key not in _VALUES:
            _VALUES[key] = self.read(name).agg(value).first()[0]
        return _VALUES[key]

    def _count(self, name: str) -> Column:
        return F.lit(self._value(name, F.count(F.lit(1)))).cast("bigint")

    @cache
    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        start = ntz(self._value("orders", F.min("o_orderdate")))
        minutes = ((key * 37) % self._count("customer")).cast("int")
        return self.read("customer").select(
            key.alias("id"),
            F.replace("c_name", F.lit("#"), F.lit("_")).alias("handle"),
            F.concat(F.lit("u"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.concat("c_mktsegment", F.lit(" person")).alias("first_name"),
            F.when(key % 3 != 0, F.concat(F.lit("p"), key.cast("string"), F.lit(".jpg"))).alias("profile_photo"),
            F.when(key % 4 != 0, F.col("c_mktsegment")).alias("bio"),
            (start + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("creation_time"),
        )

    @cache
    def post_facts(self) -> DataFrame:
        return self.read("orders").select(*self._fact_columns())

    def _fact_columns(self) -> list[Column]:
        key = F.col("o_orderkey")
        parent = F.when(key % 4 == 2, key - 1).when(key % 4 != 0, key - key % 4)
        minute = (key % 1440).cast("int")
        return [
            key.alias("post_id"),
            F.when(key % 13 == 0, F.lit(1)).otherwise(0).cast("bigint").alias("camp_id"),
            F.col("o_custkey").alias("user_id"),
            parent.alias("reply_to_id"),
            F.when(key % 5 == 0, key).alias("media_id"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("creation_time"),
            F.when(key % 11 == 5, F.lit(1)).otherwise(0).alias("is_deleted"),
        ]

    #: What a post's text is found by, and made of.
    FINDERS = ("text_key", "greeting")

    @cache
    def post_refs(self) -> DataFrame:
        """Posts with what `add_text` finds their text by."""
        key = F.col("o_orderkey")
        mentioned = self.read("customer").select(
            F.col("c_custkey").alias("mention_key"), F.replace("c_name", F.lit("#"), F.lit("_")).alias("mention")
        )
        greeting = F.when(
            key % 7 == 0, F.concat(F.lit("hi @"), F.col("mention"), F.lit(" and @nobody_here "))
        ).otherwise("")
        return (
            self.read("orders")
            .withColumn("mention_key", (key * 13) % self._count("customer"))
            .join(mentioned, "mention_key")
            .select(*self._fact_columns(), (key % self._count("documents")).alias("text_key"), greeting.alias("greeting"))
        )

    def post_arrivals(self) -> DataFrame:
        """`post_refs` of the posts that have a text; those without are no posts, and nothing may answer them."""
        texts = self.read("documents").select(F.col("doc_id").alias("text_key"))
        return self.post_refs().join(texts, "text_key", "left_semi")

    def add_text(self, rows: DataFrame) -> DataFrame:
        """Rows with the columns of `FINDERS`, and the text in their place."""
        documents = self.read("documents").select(F.col("doc_id").alias("text_key"), "text")
        # Documents are the largest table: a shuffle join at any size keeps the text spread out.
        found = rows.join(documents.hint("merge"), "text_key")
        return found.withColumn("post_text", F.concat("greeting", "text")).drop("text", *self.FINDERS)

    @cache
    def posts(self) -> DataFrame:
        return self.add_text(self.post_refs())

    @cache
    def vote_events(self) -> DataFrame:
        """Raw votes, several per voter and post."""
        post = F.col("l_orderkey")
        in_camp = (post % 13 == 0) & (post % 26 != 0)
        flag = F.col("l_returnflag")
        return self.read("lineitem").select(
            F.when(in_camp, F.lit(1)).otherwise(0).cast("bigint").alias("camp_id"),
            F.col("l_suppkey").alias("user_id"),
            post.alias("post_id"),
            F.when(flag == "N", F.lit(1.0)).when(flag == "R", F.lit(-1.0)).otherwise(F.col("l_discount")).alias("raw_value"),
            F.col("l_shipdate").alias("added_time"),
            F.col("l_linenumber").alias("line_number"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_extendedprice").alias("price"),
        )

    @cache
    def post_votes(self) -> DataFrame:
        """The vote snapshot, written once per application."""
        return written_table(self.spark, (self.state(), "post_votes"), self._post_votes)

    def _post_votes(self) -> DataFrame:
        events = normalise_votes(self.vote_events())
        current = latest_by_key(events, ["post_id", "user_id"], ["added_time", *TIE_BREAK])
        votes = current.select("camp_id", "user_id", "post_id", "value", "added_time")
        return reject_self_votes(votes, self.post_facts())

    @cache
    def follow_events(self) -> DataFrame:
        """Follows and unfollows, several per pair, self-follows included."""
        buyers = self.read("orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("user_id"))
        return (
            self.read("lineitem")
            .withColumnRenamed("l_orderkey", "post_id")
            .join(buyers, "post_id")
            .select(
                "user_id",
                F.col("l_suppkey").alias("following"),
                F.when(F.col("l_linestatus") == "O", F.lit(1)).otherwise(0).alias("follow_value"),
                F.col("l_shipdate").alias("creation_time"),
                "post_id",
                F.col("l_linenumber").alias("line_number"),
                F.col("l_partkey").alias("part_id"),
                F.col("l_extendedprice").alias("price"),
            )
        )

    FOLLOW_TIE_BREAK = ("post_id", *TIE_BREAK)

    @cache
    def follows(self) -> DataFrame:
        """The follow snapshot, written once per application."""
        return written_table(self.spark, (self.state(), "follows"), self._follows)

    def _follows(self) -> DataFrame:
        events = self.follow_events().filter(F.col("user_id") != F.col("following"))
        current = latest_by_key(events, ["user_id", "following"], ["creation_time", *self.FOLLOW_TIE_BREAK])
        return current.select("user_id", "following", "follow_value", "creation_time")

    @cache
    def notifications(self) -> DataFrame:
        event = F.col("event_id")
        kind = F.col("event_type")
        return self.read("events").select(
            event.alias("notification_id"),
            "user_id",
            ((event * 7) % self._count("customer")).alias("triggered_by_user_id"),
            F.when(kind == "signup", 1).when(kind == "click", 2).when(kind == "view", 3).otherwise(0).alias("event_type_id"),
            F.when(kind != "signup", (event * 11) % self._count("orders")).alias("reference_post_id"),
            F.when(F.col("value") > 50, 1).otherwise(0).alias("seen"),
            F.col("ts").alias("creation_time"),
        )

    @cache
    def tokens(self) -> DataFrame:
        event = F.col("event_id")
        return self.read("events").select(
            event.alias("token_id"),
            "user_id",
            F.concat(F.lit("tok"), event.cast("string")).alias("token"),
            F.when(event % 3 == 0, 1).when(event % 3 == 1, 0).alias("used"),
            F.col("ts").alias("creation_time"),
        )

    @cache
    def media(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.read("part").select(
            key.alias("media_id"), F.concat(F.lit("m"), key.cast("string"), F.lit(".png")).alias("photo_url")
        )

    @cache
    def camp_directory(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(key.alias("record_id"), (key % 3).alias("camp_id"), key.alias("user_id"))

    @cache
    def camps(self) -> DataFrame:
        return self.read("region").select(
            F.col("r_regionkey").cast("bigint").alias("camp_id"), F.col("r_name").alias("camp_name")
        )

    @cache
    def registrations(self) -> DataFrame:
        """Sign-up requests with clashing and malformed entries."""
        kind = F.col("event_type")
        user = F.col("user_id").cast("string")
        value = F.col("value")
        email = (
            F.when(kind == "error", F.lit("no address"))
            .when(kind == "click", F.concat(F.lit("U"), user, F.lit("@example.com")))
            .otherwise(F.concat(kind, user, F.lit("@example.com")))
        )
        name = (
            F.when(value > 300, F.lit(""))
            .when(value > 200, F.concat(kind, F.lit(" with a name that is far too long")))
            .otherwise(kind)
        )
        username = (
            F.when(kind == "view", F.concat(F.lit("customer_"), F.lpad(user, 9, "0")))
            .when(kind == "error", F.concat(F.lit("bad name "), user))
            .when(kind == "purchase", F.concat(F.lit("buyer_"), F.floor(value).cast("string")))
            .otherwise(F.concat(F.lit("member_"), user))
        )
        return self.read("events").select(
            F.col("event_id").alias("request_id"),
            F.col("ts").alias("request_time"),
            email.alias("email"),
            name.alias("name"),
            username.alias("username"),
        )

    def tables(self) -> SocialTables:
        return SocialTables(
            LateText(self.post_refs, self.FINDERS, self.add_text),
            users=self.users,
            posts=self.posts,
            post_votes=self.post_votes,
            follows=self.follows,
            notifications=self.notifications,
            tokens=self.tokens,
            camp_directory=self.camp_directory,
            camps=self.camps,
            media=self.media,
            post_facts=self.post_facts,
        )
