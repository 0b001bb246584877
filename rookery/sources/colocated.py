"""Tables of posts bucketed by post id, whose joins by it need no shuffle.

Posts without their text, the texts and the posts' figures are written in the same number of buckets by `post_id`, each bucket sorted. Every
join by post id then reads its buckets side by side: no side is shuffled, and texts never are. Votes come in as figures, which are
summed before they are written; the votes of one post can be very many and would all be one bucket's.

Where texts lie in another table (`LateText`) they stay there: the buckets hold what they are found by, and pages find them last. Written to its
post's bucket, each text would be shuffled once and written once for every post.

The tables are known to the session's catalog by `<name>_<table>`. Another application, whose catalog does not know them, opens them from their folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..plans.marts import Marts
from .tables import SocialTables

#: Texts are much of what is written; `zstd` takes about a third less than the default codec.
CODEC = "zstd"

TABLES = ("facts", "texts", "figures")
KEY = "post_id"


def save_by_post(t: SocialTables, marts: Marts, name: str, path: str, buckets: int, tables: Sequence[str] = TABLES) -> None:
    """Write the tables below `path`, or those of `tables`, each bucket by one task.

    With fewer buckets than shuffles have partitions Spark would shuffle the tables again when it joins them with others.
    """

    def texts() -> DataFrame:
        posts, finders = t.text_refs()
        return posts.select(KEY, "is_deleted", *finders)

    frames = {"facts": lambda: t.post_facts, "texts": texts, "figures": lambda: marts.figures}
    for table in tables:
        rows = frames[table]().repartition(buckets, KEY)
        rows.write.option("compression", CODEC).bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{path}/{table}").format("parquet").saveAsTable(f"{name}_{table}")


def open_by_post(spark: SparkSession, name: str, path: str, buckets: int) -> None:
    """Make saved tables known to this session's catalog."""
    for table in TABLES:
        schema = ", ".join(f"`{n}` {kind}" for n, kind in spark.read.parquet(f"{path}/{table}").dtypes)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name}_{table} ({schema}) USING parquet "
            f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}/{table}'"
        )


def load_by_post(t: SocialTables, marts: Marts, name: str, texts: bool = True) -> tuple[SocialTables, Marts]:
    """`t` and `marts` with posts, texts and figures from the bucketed tables: every plan takes them as they are.

    Without `texts`, for plans that read none, posts stay those of `t`.
    """
    spark = marts.figures.sparkSession
    bucketed: dict[str, DataFrame] = {table: spark.table(f"{name}_{table}") for table in TABLES if texts or table != "texts"}
    facts = bucketed["facts"]
    tables = t.with_refs(bucketed["texts"], post_facts=facts) if texts else t.with_frames(post_facts=facts)
    return tables, Marts(bucketed["figures"], marts.authors, marts.hot_authors, marts.hot_followed)
