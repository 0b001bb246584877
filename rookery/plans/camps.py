"""Camp walls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import scores_by_name
from ..operators.joins import votes_by_camp
from ..operators.predicates import posts_in_camp
from ..operators.skew import spread_join
from ..sources.tables import SocialTables
from .marts import Marts


def camp_wall(t: SocialTables, camp_id: int, name: str = "username", marts: Marts | None = None) -> DataFrame:
    """All posts of a camp with the score from the camp's votes and the author's score by name."""
    marts = marts or Marts.from_tables(t)
    votes = t.post_votes.filter(F.col("camp_id") == camp_id)
    names = scores_by_name(t.users, marts.user_scores(), name)
    columns = list(dict.fromkeys([name, "first_name"]))
    people = t.users.select(F.col("id").alias("user_id"), *columns)
    authors = spread_join(people, names, name, "user_id")
    facts = posts_in_camp(t.post_facts, camp_id)
    signed = spread_join(facts, authors, "user_id", "post_id", counted=facts)
    # The text joins last, on the key of the votes, so that it is shuffled once, or not at all where it is found later.
    posts, finders = t.text_refs()
    texts = posts_in_camp(posts, camp_id).select("camp_id", "post_id", *finders)
    return t.add_text(votes_by_camp(signed, votes).join(texts, ["camp_id", "post_id"]))
