"""Vote events to current votes, as a log of deltas merged when read.

A micro-batch costs as much as its own events: it never rewrites the snapshot. Each batch
writes its newest vote per key to a folder named by the batch id, so a repeated batch
overwrites itself. `current_votes` merges snapshot and deltas by event time, which also
gives late events their right place; `compact` writes that as the next snapshot.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import VOTE_KEY, apply_votes, normalise_votes, reject_self_votes
from ..operators.ranking import latest_by_key

VOTE_COLUMNS = ("camp_id", "user_id", "post_id", "value", "added_time")


def stream_votes(
    events: DataFrame,
    posts: Callable[[], DataFrame],
    path: str,
    rule: str = "exact",
    tie_break: Sequence[str] = (),
) -> StreamingQuery:
    """Process all waiting vote events; run again for later ones.

    `posts` is called per batch, so that votes on posts written meanwhile are checked too.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # Votes go to recent posts: the id range lets the scan of posts skip most of them.
        low, high = batch.agg(F.min("post_id"), F.max("post_id")).first()
        voted = posts().filter(F.col("post_id").between(low, high))
        newest = latest_by_key(normalise_votes(batch, rule), VOTE_KEY, ["added_time", *tie_break])
        newest = reject_self_votes(newest.select(*VOTE_COLUMNS, *tie_break), voted)
        newest.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")

    return (
        events.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def read_deltas(spark: SparkSession, path: str, after: int | None = None, until: int | None = None) -> DataFrame:
    """Deltas of the batches after `after` and up to `until`; others are not read."""
    deltas = spark.read.parquet(f"{path}/deltas")
    if after is not None:
        deltas = deltas.filter(F.col("batch_id") > after)
    if until is not None:
        deltas = deltas.filter(F.col("batch_id") <= until)
    return deltas.drop("batch_id")


def current_votes(
    spark: SparkSession,
    path: str,
    snapshot: DataFrame | None = None,
    tie_break: Sequence[str] = (),
    after: int | None = None,
    until: int | None = None,
) -> DataFrame:
    """The newest vote per (camp, user, post) of a snapshot and the deltas it does not hold yet."""
    deltas = read_deltas(spark, path, after, until)
    if snapshot is None:
        return latest_by_key(deltas, VOTE_KEY, ["added_time", *tie_break]).select(*VOTE_COLUMNS)
    return apply_votes(snapshot.select(*VOTE_COLUMNS), deltas, tie_break)


def compact(
    spark: SparkSession,
    path: str,
    target: str,
    snapshot: DataFrame | None = None,
    tie_break: Sequence[str] = (),
    after: int | None = None,
) -> int:
    """Write snapshot and newer deltas as a new snapshot in a new folder.

    Returns the last batch it holds: pass it as `after` when reading with that snapshot, and to
    `retire_deltas` when no reader uses the snapshot before.
    """
    last = spark.read.parquet(f"{path}/deltas").select(F.max("batch_id")).first()[0]
    merged = current_votes(spark, path, snapshot, tie_break, after, until=last)
    merged.write.mode("errorifexists").parquet(target)
    return last


def retire_deltas(spark: SparkSession, path: str, until: int) -> None:
    """Delete the deltas of the batches up to `until`, which a snapshot holds."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/deltas")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) <= until:
            files.delete(status.getPath(), True)
