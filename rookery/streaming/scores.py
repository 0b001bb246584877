"""Scores of posts and authors, kept up to date by a stream of votes.

A batch costs as much as its own votes and the buckets of figures they touch: no reader sums all votes again, and the table of votes itself
takes several batches in at once; until then their changes, sorted by post, are read beside it. Each vote that is newer than the stored one of its
voter and post changes the post's figures by the new value less the old, and those changes are summed per post and per author before they
are added to the stored figures. A batch first writes down what it changes, from the tables as they were before it; every table then takes
that in as the version of the batch, so a batch that is repeated, whole or from half way, changes nothing.

Votes on posts that are not there yet wait, because whose score they change (and whether they are votes of their author) is not known.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import VOTE_KEY, normalise_votes
from ..operators.prefilter import restrict_by_bitmap
from ..operators.ranking import latest_by_key
from ..operators.skew import ROWS_PER_SALT, SALT, every_salt, hot_keys, one_salt
from ..session import delete_folder, finished_versions
from ..sources.buckets import BucketedTable

_POSTS = "post_id bigint, post_score bigint, up_votes bigint, down_votes bigint"
_AUTHORS = "user_id bigint, user_score bigint"
#: Batches whose changed votes are brought into the table of votes at once; until then their changes are read beside it.
FOLD = 8


class ScoreTables:
    """The tables below `path`: current votes, figures of posts and scores of authors.

    `buckets` share each range of `width` post ids, and `author_buckets` hold all authors.
    """

    def __init__(self, spark: SparkSession, path: str, events: DataFrame | None = None, tie_break: Sequence[str] = (), buckets: int = 1, width: int = 1 << 20, author_buckets: int = 16) -> None:
        self.spark, self.path, self.tie_break = spark, path, list(tie_break)
        types = {} if events is None else {f.name: f.dataType.simpleString() for f in events.schema}
        self.order = ["added_time", *self.tie_break]
        self.vote_schema = ", ".join([*(f"{c} {types.get(c, 'bigint')}" for c in [*VOTE_KEY, *self.order]), "value int"])
        self.votes = BucketedTable(spark, f"{path}/votes", self.vote_schema, VOTE_KEY, buckets, "post_id", width)
        self.posts = BucketedTable(spark, f"{path}/posts", _POSTS, ["post_id"], buckets, "post_id", width)
        self.authors = BucketedTable(spark, f"{path}/authors", _AUTHORS, ["user_id"], author_buckets)

    def _noted(self, batch_id: int) -> DataFrame:
        schema = f"{self.vote_schema}, old_value int, author_id bigint"
        return self.spark.read.schema(schema).parquet(f"{self.path}/changes/batch_id={batch_id}")

    def batches(self) -> list[int]:
        """The batches whose changes are written."""
        return finished_versions(self.spark, f"{self.path}/changes", "batch_id")

    def changes(self, batch_id: int) -> DataFrame:
        return self._noted(batch_id).filter(F.col("author_id").isNotNull())

    def waiting(self, before: int | None = None) -> DataFrame:
        """Votes on posts that were not there when the last batch before `before` was processed."""
        done = [b for b in self.batches() if before is None or b < before]
        if not done:
            return self.spark.createDataFrame([], self.vote_schema)
        names = [*VOTE_KEY, *self.order, "value"]
        return self._noted(done[-1]).filter(F.col("author_id").isNull()).select(*names)

    def _folded(self, version: int) -> int:
        """The newest version up to `version` that the table of votes has rows of its own in: it holds the changes of all batches before it."""
        written = set(finished_versions(self.spark, f"{self.votes.path}/data", "version", marker=None))
        return max((v for v in self.votes.versions() if v <= version and v in written), default=0)

    def pending(self, batch_id: int) -> list[int]:
        """The batches before `batch_id` whose changes the table of votes does not hold yet."""
        folded = self._folded(batch_id)
        return [b for b in self.batches() if folded <= b < batch_id]

    def current_votes(self, batch_id: int, low: int, high: int, touched: set[int]) -> DataFrame:
        """The stored votes on posts from `low` to `high` before the batch with the `_batch` that wrote them; of a vote that was changed lately, the older ones too."""
        names = [*VOTE_KEY, *self.order, "value"]
        stored = self.votes.read(batch_id, touched).select(*names, F.lit(-1).cast("bigint").alias("_batch"))
        return self._with_pending(stored, batch_id).filter(F.col("post_id").between(low, high))

    def _with_pending(self, rows: DataFrame, batch_id: int) -> DataFrame:
        for b in self.pending(batch_id):
            rows = rows.unionByName(self.changes(b).withColumn("_batch", F.lit(b).cast("bigint")).select(*rows.columns))
        return rows

    def note_changes(self, arrived: DataFrame, posts: Callable[[], DataFrame], batch_id: int) -> None:
        """Write which votes wait, and which are newer than the stored ones, with what they replace.

        Events and the stored votes of the same keys are ranked together, shuffled once by post as the join with posts needs them.
        """
        names = [*VOTE_KEY, *self.order, "value"]
        span = arrived.groupBy(self.votes.bucket().alias("bucket"))
        spans = span.agg(F.min("post_id").alias("low"), F.max("post_id").alias("high"), F.count(F.lit(1)).alias("n")).collect()
        ids = [i for s in spans for i in (s.low, s.high) if i is not None]
        low, high = (min(ids), max(ids)) if ids else (0, -1)
        # Votes go to recent posts: the id range lets the scans skip most of the others.
        authors = posts().filter(F.col("post_id").between(low, high)).select("post_id", F.col("user_id").alias("author_id"))
        key = F.xxhash64(*[F.col(c).cast("bigint") for c in VOTE_KEY])
        stored = self.current_votes(batch_id, low, high, {s.bucket for s in spans}).withColumn("_key", key)
        stored = restrict_by_bitmap(stored, arrived.select(key.alias("_key")), "_key", least_bits=2).drop("_key")
        # Where posts are repeated so are their votes, and a change of such a vote counts for each.
        stored = stored.groupBy(*names, "_batch").agg(F.count(F.lit(1)).alias("_copies"))
        both = arrived.select(*names).withColumn("_stored", F.lit(False)).unionByName(stored.withColumn("_stored", F.lit(True)), allowMissingColumns=True)
        # Only a bucket with very many votes can hold a hot post.
        hot = hot_keys(arrived.filter(self.votes.bucket().isin([s.bucket for s in spans if s.n > ROWS_PER_SALT])), "post_id")
        placed = one_salt(both, "post_id", hot, "user_id").repartition("post_id", SALT)
        order = F.struct(*self.order)
        whole = Window.partitionBy(*reversed(VOTE_KEY), SALT).orderBy("_stored", *[F.col(c).desc() for c in self.order])
        old = F.max(F.when(F.col("_stored"), F.struct("_batch", order.alias("order"), "value", "_copies"))).over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        newest = placed.withColumn("_rank", F.row_number().over(whole)).withColumn("_old", old).filter((F.col("_rank") == 1) & ~F.col("_stored"))
        known = newest.join(every_salt(authors, "post_id", hot), ["post_id", SALT], "left")
        newer = F.col("_old").isNull() | (order >= F.col("_old.order"))
        changed = known.filter(F.col("author_id").isNull() | ((F.col("author_id") != F.col("user_id")) & newer))
        copies = F.when(F.col("author_id").isNull(), F.lit(1)).otherwise(F.coalesce("_old._copies", F.lit(1))).cast("int")
        changed = changed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), copies)))
        changed.select(*names, F.col("_old.value").alias("old_value"), "author_id").write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")

    def take_in(self, batch_id: int) -> None:
        """Bring all tables to the version after the batch, whose changes are written."""
        changes = self.changes(batch_id)
        version = batch_id + 1

        def replace(rows: DataFrame, events: DataFrame) -> DataFrame:
            return rows.join(events, list(VOTE_KEY), "left_anti").unionByName(events.select(*rows.columns))

        new, old = F.col("value").cast("bigint"), F.coalesce("old_value", F.lit(0)).cast("bigint")
        up: Callable[[Column], Column] = lambda v: (v > 0).cast("bigint")
        down: Callable[[Column], Column] = lambda v: (v < 0).cast("bigint")
        per_post = changes.groupBy("post_id", "author_id").agg(
            F.sum(new - old).alias("post_score"),
            F.sum(up(new) - up(old)).alias("up_votes"),
            F.sum(down(new) - down(old)).alias("down_votes"),
        )
        # Three jobs read them.
        folder = f"{self.path}/sums/batch_id={batch_id}"
        if batch_id not in finished_versions(self.spark, f"{self.path}/sums", "batch_id"):
            per_post.write.mode("overwrite").parquet(folder)
        per_post = self.spark.read.schema(per_post.schema).parquet(folder)
        per_author = per_post.groupBy(F.col("author_id").alias("user_id")).agg(F.sum("post_score").alias("user_score"))

        def fold_votes() -> None:
            pending = self.pending(batch_id)
            if len(pending) + 1 < FOLD:
                self.votes.carry(version)
                return
            rows = changes.select(*VOTE_KEY, *self.order, "value", F.lit(batch_id).cast("bigint").alias("_batch"))
            last = F.rank().over(Window.partitionBy(*VOTE_KEY).orderBy(F.col("_batch").desc()))
            rows = self._with_pending(rows, batch_id).withColumn("_last", last).filter("_last = 1")
            self.votes.merge(rows.drop("_last", "_batch"), replace, version)

        merges = [
            fold_votes,
            lambda: self.posts.merge(per_post, add_by("post_id"), version, by_bucket=True),
            lambda: self.authors.merge(per_author, add_by("user_id"), version, by_bucket=True),
        ]
        # None needs another's result, so their jobs run side by side.
        with ThreadPoolExecutor(len(merges)) as pool:
            jobs = [pool.submit(inheritable_thread_target(self.spark)(merge)) for merge in merges]
        for job in jobs:
            job.result()

    def changed_posts(self, batch_id: int) -> DataFrame:
        """The figures of the posts whose votes the batch changed; only their buckets are read."""
        ids = self.changes(batch_id).select("post_id").distinct()
        return self.posts.read(only=self.posts.touched(ids)).join(ids, "post_id", "left_semi")

    def changed_authors(self, batch_id: int) -> DataFrame:
        """The scores of these posts' authors."""
        ids = self.changes(batch_id).select(F.col("author_id").alias("user_id")).distinct()
        return self.authors.read(only=self.authors.touched(ids)).join(ids, "user_id", "left_semi")

    def retire(self, batch_id: int) -> None:
        """Delete what only batches before `batch_id` need. Its own repetition stays possible."""
        needed = self.pending(batch_id)
        for table in (self.votes, self.posts, self.authors):
            table.retire(batch_id)
        for name in ("changes", "sums"):
            for old in finished_versions(self.spark, f"{self.path}/{name}", "batch_id"):
                if old < batch_id - 1 and not (name == "changes" and old in needed):
                    delete_folder(self.spark, f"{self.path}/{name}/batch_id={old}")


def add_by(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A change that adds the events' figures to those of the rows with the same key; rows that name their bucket are brought together by it."""

    def change(rows: DataFrame, events: DataFrame) -> DataFrame:
        by = [c for c in ("bucket", key) if c in rows.columns]
        both = rows.unionByName(events.select(*rows.columns))
        if "bucket" in by:
            both = both.repartition("bucket")
        return both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])

    return change


def process_votes(tables: ScoreTables, batch: DataFrame, batch_id: int, posts: Callable[[], DataFrame], rule: str = "exact") -> None:
    """Take one batch of vote events in. Doing so again, whole or after a failure, gives the same tables."""
    if batch_id not in tables.batches():
        waiting = tables.waiting(batch_id)
        arrived = normalise_votes(batch, rule).select(*waiting.columns).unionByName(waiting)
        tables.note_changes(arrived, posts, batch_id)
    tables.take_in(batch_id)


def stream_scores(
    events: DataFrame,
    posts: Callable[[], DataFrame],
    path: str,
    rule: str = "exact",
    tie_break: Sequence[str] = (),
    retire: bool = True,
    **layout: int,
) -> StreamingQuery:
    """Process all waiting vote events; run again for later ones. `posts` is called per batch.

    With `retire`, versions that a repeated batch can no longer need are deleted; a reader that takes longer than a batch needs them kept.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        tables = ScoreTables(batch.sparkSession, path, batch, tie_break, **layout)
        process_votes(tables, batch, batch_id, posts, rule)
        if retire:
            tables.retire(batch_id)

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def post_figures(spark: SparkSession, path: str, **layout: int) -> DataFrame:
    """(post_id, post_score, up_votes, down_votes) of every voted post, as the last batch left them."""
    return ScoreTables(spark, path, **layout).posts.read()


def author_scores(spark: SparkSession, path: str, **layout: int) -> DataFrame:
    """(user_id, user_score) of every author with votes."""
    return ScoreTables(spark, path, **layout).authors.read()
