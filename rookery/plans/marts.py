"""Scores and counts that all pages share.

They are plain lazy frames. A job that builds several pages writes them once with
`save` and goes on with `load`, instead of summing all votes again for every page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..operators.joins import AUTHOR_COLUMNS
from ..operators.skew import SALTS, hot_keys, spread_join
from ..sources.tables import SocialTables

_SCHEMAS = {
    "figures": "post_id BIGINT, post_score BIGINT, up_votes BIGINT, down_votes BIGINT, reply_count BIGINT",
    "authors": "user_id BIGINT, first_name STRING, handle STRING, profile_photo STRING, "
    "user_score BIGINT, is_top_user BOOLEAN",
    "hot_authors": f"user_id BIGINT, {SALTS} INT",
    "hot_followed": f"author_id BIGINT, {SALTS} INT",
}


@dataclass(frozen=True)
class Marts:
    """`figures` has one row per post with votes or replies, `authors` one per user: what a post shows
    about its author. `hot_authors` and `hot_followed` list users with very many posts and followers, for
    salted joins."""

    figures: DataFrame
    authors: DataFrame
    hot_authors: DataFrame
    hot_followed: DataFrame

    @classmethod
    def from_tables(cls, t: SocialTables, figures: DataFrame | None = None) -> Marts:
        """`figures` is that frame where it is written already; votes are then not read again."""
        if figures is None:
            figures = aggregates.post_stats(t.post_votes).join(aggregates.reply_count(t.post_facts), "post_id", "full")
        scores = aggregates.author_score_of(t.post_facts, figures)
        people = t.users.select(F.col("id").alias("user_id"), *AUTHOR_COLUMNS)
        followers = t.follows.filter(F.col("follow_value") == 1).select(F.col("following").alias("author_id"))
        return cls(
            figures=figures,
            authors=flag_top_user(people.join(scores, "user_id", "left"), people.join(scores, "user_id", "left")),
            hot_authors=hot_keys(t.post_facts, "user_id"),
            hot_followed=hot_keys(followers, "author_id"),
        )

    @classmethod
    def save(cls, t: SocialTables, path: str) -> None:
        """Write all frames below `path`. Votes are summed once: author scores are made of the written figures."""
        spark = t.post_votes.sparkSession
        first = cls.from_tables(t)
        first.figures.sortWithinPartitions("post_id").write.mode("errorifexists").parquet(f"{path}/figures")
        figures = spark.read.schema(_SCHEMAS["figures"]).parquet(f"{path}/figures")
        rest = cls.from_tables(t, figures)
        for name in _SCHEMAS:
            if name != "figures":
                getattr(rest, name).write.mode("errorifexists").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Marts:
        return cls(
            **{name: spark.read.schema(ddl).parquet(f"{path}/{name}") for name, ddl in _SCHEMAS.items()}
        )

    def user_scores(self) -> DataFrame:
        return self.authors.select(F.col("user_id").alias("id"), "user_score")


def flag_top_user(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Add `is_top_user` to rows with a `user_id`, given (user_id, user_score) of everyone."""
    best = aggregates.top_user(scores.withColumnRenamed("user_id", "id")).select("id")
    return df.withColumn("is_top_user", F.coalesce(F.col("user_id") == best.scalar(), F.lit(False)))


def post_cards(
    t: SocialTables,
    marts: Marts,
    posts: DataFrame,
    viewer_id: int | None = None,
    all_posts: bool = False,
) -> DataFrame:
    """Posts with scores, counts and author.

    With a viewer, `current_user_vote` is that user's vote; without one the column is left out.
    The author comes first: pages that rank posts by author are partitioned for it already. Where
    `all_posts` are shown an author can hold many of them, and the join by author is salted.
    """
    if all_posts:
        cards = spread_join(posts, marts.authors, "user_id", "post_id", hot=marts.hot_authors)
    else:
        cards = posts.join(marts.authors, "user_id", "left")
    cards = cards.join(marts.figures, "post_id", "left")
    missing = {"is_top_user": False}
    if viewer_id is not None:
        mine = t.post_votes.filter(F.col("user_id") == viewer_id)
        vote = aggregates.post_score(mine).withColumnRenamed("post_score", "current_user_vote")
        cards = cards.join(vote, "post_id", "left")
        missing["current_user_vote"] = 0
    return cards.fillna(missing)
