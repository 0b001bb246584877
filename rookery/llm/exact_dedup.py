"""Exact duplicates by progressive refinement.

Texts are equal when identical without white space. Rows are first told apart by the length of
that normalised text, then by a hash of its beginning, and only rows that still share both are grouped by
the SHA-256 of the whole. Every level reads and shuffles only the rows that the one before left.
`exact_duplicates` names the digest of every row, kept or not, so it takes it in the one scan that leaves a narrow row per document;
`drop_exact_duplicates` digests only what shares length and prefix with another row. No text is shuffled but, where rows are dropped, theirs.

Counts and keepers are aggregated before they are shuffled, so a group that holds a third of all rows is
one row per map task; the joins back to the rows read written tables, so adaptive execution can split hot keys.

Defined results: null text is the empty text; the keeper has the most code points in the original,
then the smallest doc_id (null ids last); of rows that repeat the keeper's id with the same text, the longest original stays,
one of them; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, filled, marked, marks, stored

#: Code points of the normalised text whose hash makes the second level.
PREFIX = 256


def normalised(text: Column) -> Column:
    return reduce(lambda c, space: F.replace(c, F.lit(space), F.lit("")), SPACES, filled(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, points, norm_length, prefix_hash, text_sha256) of each row, from one read of the texts."""
    texts = docs.select("doc_id", F.length(filled("text")).alias("points"), normalised(F.col("text")).alias("norm"))
    return texts.select(
        "doc_id",
        "points",
        F.length("norm").alias("norm_length"),
        F.xxhash64(F.left("norm", F.lit(PREFIX))).alias("prefix_hash"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def _shared(spark: SparkSession, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rows whose `keys` other rows have too."""
    more = stored(spark, rows.groupBy(*keys).count().where("count > 1").select(*keys), f"{name}-keys")
    return stored(spark, rows.join(more, keys, "left_semi"), name)


def duplicate_groups(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(sha256, keep_id, keep_place, group_size) of every text that more than one row has."""
    by_length = _shared(spark, rows, ["norm_length"], "same-length")
    by_prefix = _shared(spark, by_length, ["norm_length", "prefix_hash"], "same-prefix")
    first = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("place")))
    groups = by_prefix.groupBy("text_sha256").agg(F.count("*").alias("group_size"), first.alias("first"))
    groups = groups.where("group_size > 1").select(
        F.col("text_sha256").alias("sha256"), F.col("first.doc_id").alias("keep_id"), F.col("first.place").alias("keep_place"), "group_size"
    )
    return stored(spark, groups, "equal-texts")


def exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too."""
    rows = stored(spark, fingerprints(docs).withColumn("place", F.monotonically_increasing_id()), "fingerprints")
    groups = duplicate_groups(spark, rows)
    each = rows.join(groups, F.col("text_sha256") == F.col("sha256"), "left")
    keep = F.when(F.col("sha256").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return each.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("sha256").isNull() | (F.col("place") == F.col("keep_place"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """`docs` with all columns, and one row of each group of equal texts.

    Lengths and prefix hashes are taken in a first read; whole texts are digested in the second, and only those that share both.
    """
    norm = normalised(F.col("text"))
    level = F.concat_ws(":", F.length(norm).cast("string"), F.xxhash64(F.left(norm, F.lit(PREFIX))).cast("string"))
    counts = docs.select(level.alias("__level")).groupBy("__level").agg(F.count("*").alias("n"))
    shared = stored(spark, counts.where("n > 1").select("__level"), "shared-lengths-and-prefixes")
    rows = marked(docs.withColumn("__level", level), "__level", marks(spark, shared))
    alike = rows.where("__marked").select(*docs.columns, F.sha2(norm, 256).alias("__sha"), F.monotonically_increasing_id().alias("__place"))
    alike = stored(spark, alike, "alike")
    first = F.min(F.struct(-F.length(filled("text")), F.col("doc_id").isNull(), F.col("doc_id"), F.col("__place").alias("place")))
    kept = alike.groupBy("__sha").agg(first.alias("first")).select(F.col("first.place").alias("__place"))
    kept = alike.join(stored(spark, kept, "kept"), "__place", "left_semi")
    return rows.where("NOT __marked").select(*docs.columns).unionByName(kept.select(*docs.columns))
