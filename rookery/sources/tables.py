"""Loading and saving the social tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import local_month
from .schemas import LAYOUT, NUMERIC_KEY, SOCIAL


@dataclass(frozen=True)
class LateText:
    """How posts get a text that lies in another table.

    `refs` gives the posts with the columns `finders` in place of `post_text`; `add` puts the text in their place, in any rows that carry them.
    """

    refs: Callable[[], DataFrame]
    finders: tuple[str, ...]
    add: Callable[[DataFrame], DataFrame]


class SocialTables:
    """The nine tables every plan reads, as attributes.

    Tables are given as frames, or as functions that are called when the table is first read.
    `post_facts` is posts without the text. It defaults to a projection of posts; a source
    that has to join for the text can supply a cheaper frame. Such a source can also say by `late_text` how
    pages find their texts last, so that no text is shuffled to its post.
    """

    def __init__(self, late_text: LateText | None = None, **frames: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(frames) - set(SOCIAL) - {"post_facts"}
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._frames = frames
        self._late_text = late_text

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__["_frames"]
        if name == "post_facts" and name not in frames:
            frames[name] = self.posts.drop("post_text")
        if name not in frames:
            raise AttributeError(f"no table {name!r} was given")
        if not isinstance(frames[name], DataFrame):
            frames[name] = frames[name]()
        return frames[name]

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SOCIAL if name in self._frames}

    def text_refs(self) -> tuple[DataFrame, tuple[str, ...]]:
        """Posts with what stands for their text, and the columns that do: the text itself, or what `add_text` finds it by."""
        if self._late_text is None:
            return self.posts, ("post_text",)
        return self._late_text.refs(), self._late_text.finders

    def add_text(self, rows: DataFrame) -> DataFrame:
        """Rows that carry the columns of `text_refs`, with the text in their place."""
        return rows if self._late_text is None else self._late_text.add(rows)

    def with_frames(self, **frames: DataFrame) -> SocialTables:
        """A copy with some tables replaced, for example by the result of a change job."""
        kept = dict(self._frames)
        if "posts" in frames:
            kept.pop("post_facts", None)
        late_text = None if "posts" in frames else self._late_text
        return SocialTables(late_text, **{**kept, **frames})

    def with_refs(self, refs: DataFrame, **frames: DataFrame) -> SocialTables:
        """A copy with other posts, given with the columns that `text_refs` names: their text itself, or what it is found by as before."""
        if self._late_text is None:
            return self.with_frames(posts=refs, **frames)
        kept = {name: frame for name, frame in self._frames.items() if name != "post_facts"}
        late_text = LateText(lambda: refs, self._late_text.finders, self._late_text.add)
        return SocialTables(late_text, **{**kept, "posts": lambda: self.add_text(refs), **frames})


def load_tables(spark: SparkSession, path: str) -> SocialTables:
    """Read `<path>/<table>` with fixed schemas; missing columns read as NULL.

    The columns of `LAYOUT` come along, so that filters on them skip files.
    """
    return SocialTables(
        **{
            name: spark.read.schema(", ".join([schema, *filter(None, [LAYOUT.get(name)])])).parquet(f"{path}/{name}")
            for name, schema in SOCIAL.items()
        }
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the fixed schema of `table`; columns the frame lacks become NULL."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(SOCIAL[table])
        ]
    )


#: Posts that one task sorts with their texts, so that sorts of any table stay in memory.
POSTS_PER_TASK = 50_000


def post_tasks(posts: DataFrame) -> int:
    """How many tasks sort the posts, at least as many as shuffles have partitions; `posts` are counted and need no texts."""
    least = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-posts.count() // POSTS_PER_TASK))


def save_tables(tables: SocialTables, path: str) -> None:
    """Write a snapshot of all tables to a new folder; the folder being read is never overwritten.

    Posts are partitioned by local month and sorted by id within it, users are sorted by their handle in lower case.
    """
    for name, df in tables.frames().items():
        rows = conform(df, name)
        if name == "users":
            rows = rows.withColumn("handle_lower", F.lower("handle")).repartitionByRange("handle_lower").sortWithinPartitions("handle_lower")
        elif name == "posts":
            rows = rows.withColumn("local_month", local_month(F.col("creation_time")))
            rows = rows.repartitionByRange(post_tasks(tables.post_facts), "local_month", "post_id").sortWithinPartitions("local_month", "post_id")
        # Texts are much of what is written; zstd takes about a third less than the default codec.
        writer = rows.write.mode("errorifexists").option("compression", "zstd")
        (writer.partitionBy("local_month") if name == "posts" else writer).parquet(f"{path}/{name}")


def jdbc_options(
    table: str, url: str, bounds: tuple[int, int], partitions: int, extra: Mapping[str, str] | None = None
) -> dict[str, str]:
    """Options of a parallel range read on the numeric key of `table`."""
    low, high = bounds
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": NUMERIC_KEY[table],
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
        **(extra or {}),
    }


def load_tables_jdbc(
    spark: SparkSession,
    url: str,
    bounds: Mapping[str, tuple[int, int]],
    partitions: int = 64,
    extra: Mapping[str, str] | None = None,
) -> SocialTables:
    """Read the tables from a database; `bounds` gives the id range of each table."""
    return SocialTables(
        **{
            name: conform(
                spark.read.format("jdbc")
                .options(**jdbc_options(name, url, bounds[name], partitions, extra))
                .load(),
                name,
            )
            for name in SOCIAL
        }
    )
