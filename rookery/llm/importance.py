"""Importance resampling towards a target's word distribution.

Features are a text's words, and pairs of neighbours if asked for; a feature's bucket is the CRC of its bytes modulo the
number of buckets. A head vocabulary of frequent words and pairs is found in one pass and broadcast: the CRC
state of each word, from which a pair that starts with it goes on, and the bucket of each pair. All other features take
their CRC directly, so the vocabulary decides how fast a bucket is found and never which: bucket totals are exact. A
document's weight is the mean gain of its features, where a bucket's gain says how much more often the target has it; its
score adds a Gumbel draw hashed from its id, and the highest scores are drawn without replacement.

Nothing but word counts, bucket totals and one narrow row per document is shuffled. The head is bounded
by `HEAD` entries of at most `WORD` bytes each, the totals by the number of buckets.

Defined results: null and empty texts have no features, weight 0, and are not drawn; rows that repeat an id share its draw, and
of equal rows as many are drawn as their scores reach; a null id is hashed as the empty text and comes last among ties; an empty
target makes all features' gains those of a target without words; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, row_key, stored

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
#: Words and pairs of the head vocabulary, each, and the bytes of the longest that is admitted.
HEAD, WORD = 1 << 16, 64
#: Distinct words and pairs a task counts before it lets the rarer half go.
COUNTED = 1 << 18

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes beyond ASCII, with A-Z in lower case."""
    return text.translate(_LOWER).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


class Head:
    """The bucket of any feature: by look-up of frequent ones, by CRC of all others."""

    def __init__(self, states: dict[bytes, int], pairs: dict[tuple[bytes, bytes], int], buckets: int) -> None:
        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                return zlib.crc32(word) % buckets

        class Pairs(dict):
            def __missing__(self, pair: tuple[bytes, bytes]) -> int:
                first, second = pair
                state = states.get(first)
                return zlib.crc32(b" " + second, zlib.crc32(first) if state is None else state) % buckets

        self.words = Words((w, s % buckets) for w, s in states.items())
        self.pairs = Pairs(pairs)

    def buckets_of(self, words: list[bytes], longest: int) -> np.ndarray:
        found = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if longest == 1 or len(words) < 2:
            return found
        pairs = np.fromiter(map(self.pairs.__getitem__, zip(words, words[1:])), np.int64, len(words) - 1)
        return np.concatenate([found, pairs])


def _frequent(longest: int) -> Callable:
    """A task's most frequent words and pairs; a count may lack what was let go."""

    def thin(counts: Counter, most: int) -> Counter:
        return Counter(dict(counts.most_common(most))) if len(counts) > most else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = Counter(), Counter()
        for batch in batches:
            for text in _texts(batch.column(0)):
                own = words_of(text)
                words.update(own)
                if longest > 1:
                    pairs.update(zip(own, own[1:]))
                if len(words) > COUNTED:
                    words = thin(words, COUNTED // 2)
                if len(pairs) > COUNTED:
                    pairs = thin(pairs, COUNTED // 2)
        for size, counts in ((1, words), (2, pairs)):
            short = Counter({w: n for w, n in counts.items() if (len(w) if size == 1 else len(w[0]) + len(w[1])) <= WORD})
            found = thin(short, HEAD)
            grams = [w if size == 1 else b" ".join(w) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([size] * len(grams), pa.int32()), pa.array(grams, pa.binary()), pa.array(found.values(), pa.int64())], names=["size", "gram", "n"])

    return run


def head_vocabulary(spark: SparkSession, docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int]]:
    """CRC states of frequent words and buckets of frequent pairs, at most `HEAD` each.

    Words are in by the magnitude (in bits) of their counts: as many magnitudes, from the highest, as `HEAD` has room for whole.
    """
    counts = docs.select("text").mapInArrow(_frequent(longest), "size int, gram binary, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    counts = stored(spark, counts.withColumn("magnitude", F.floor(F.log2("n")).cast("int")), "frequent")
    levels = counts.groupBy("size", "magnitude").count().collect()  # at most 64 for either size
    states: dict[bytes, int] = {}
    pairs: dict[tuple[bytes, bytes], int] = {}
    for size in range(1, longest + 1):
        least, total = None, 0
        for level in sorted((r for r in levels if r.size == size), key=lambda r: -r.magnitude):
            total += level["count"]
            if total > HEAD:
                break
            least = level.magnitude
        if least is None:
            continue
        for row in counts.where((F.col("size") == size) & (F.col("magnitude") >= least)).select("gram").collect():  # at most HEAD
            gram = bytes(row.gram)
            if size == 1:
                states[gram] = zlib.crc32(gram)
            else:
                first, second = gram.split(b" ")
                pairs[first, second] = zlib.crc32(gram) % buckets
    return states, pairs


def _totals(head: Broadcast, longest: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Head(*head.value, buckets)
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                totals += np.bincount(known.buckets_of(words_of(text), longest), minlength=buckets)
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(totals[seen], pa.int64())], names=["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, head: Broadcast, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket is hit in all texts."""
    parts = docs.select("text").mapInArrow(_totals(head, longest, buckets), "bucket int, n long")
    totals = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        totals[row.bucket] = row.n
    return totals


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By how much the target's share of each bucket is above the source's, on a scale of `SCALE` per unit of logarithm."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: (t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))
    return np.array([math.floor(SCALE * math.log(ratio(s, t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(head: Broadcast, gains: np.ndarray, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Head(*head.value, len(gains))
        for batch in batches:
            *others, texts = batch.columns
            n_words, n_features, weights = [], [], []
            for text in _texts(texts):
                words = words_of(text)
                found = known.buckets_of(words, longest)
                n_words.append(len(words))
                n_features.append(len(found))
                weights.append(int(gains[found].sum()) // len(found) if len(found) else 0)
            counts = [pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([*others, *counts], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    return run


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw on the same scale as the gains, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), filled(doc_id.cast("string"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(spark: SparkSession, docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, *more: Column) -> DataFrame:
    """(doc_id, `more`, n_words, n_features, weight, score) of each row of `docs`."""
    if longest not in (1, 2):
        raise ValueError("features are words, or words and pairs: longest is 1 or 2")
    head = spark.sparkContext.broadcast(head_vocabulary(spark, docs, longest, buckets))
    gains = bucket_gains(bucket_totals(docs, head, longest, buckets), bucket_totals(target, head, longest, buckets))
    texts = docs.select("doc_id", *more, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]]
    weighed = texts.mapInArrow(_weighed(head, gains, longest), ", ".join([*kinds, "n_words long, n_features long, weight long"]))
    return weighed.withColumn("score", F.col("weight") + draw(F.col("doc_id"), seed))


def importance_ranks(spark: SparkSession, docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, *more: Column) -> DataFrame:
    """(doc_id, `more`, n_words, n_features, weight, score, rank) of each row; rank is null where it is not drawn.

    Of the rows with at least `least_words` words the `percent` of a hundred with the highest scores are drawn.
    """
    rows = scored(spark, docs, target, longest, buckets, seed, *more).withColumn("__place", F.monotonically_increasing_id())
    rows = stored(spark, rows, "importance")
    able = F.col("n_words") >= least_words
    n_drawn = rows.where(able).count() * percent // 100
    # Places in the order: rows are spread by ranges of it, and a range's first place follows from the counts of those before.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("__place")]
    dealt = rows.where(able).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    dealt = stored(spark, dealt, "importance-order")
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = dealt.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__first"))
    first = stored(spark, first, "importance-firsts")  # one row per part
    dealt = dealt.join(first, "__part")
    late = F.col("__first") >= n_drawn
    place = F.col("__first") + F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    none = F.lit(None).cast("long")
    drawn = dealt.where(~late).withColumn("rank", F.when(place <= n_drawn, place).otherwise(none))
    left = dealt.where(late).withColumn("rank", none).unionByName(rows.where(~able).withColumn("rank", none), allowMissingColumns=True)
    return drawn.unionByName(left, allowMissingColumns=True).drop("__place", "__part", "__first")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of `docs`, with all columns."""
    key = row_key(F.col("doc_id"), F.xxhash64("text"))
    ranks = importance_ranks(spark, docs, target, longest, buckets, least_words, percent, seed, key.alias("__key"))
    each = ranks.groupBy("__key").agg(F.count("rank").alias("__n"), F.count("*").alias("__all"))
    each = stored(spark, each.where("__n > 0"), "importance-drawn")
    rows = docs.withColumn("__key", key).join(each, "__key")
    # Equal rows have equal scores, so at most one set of them is drawn in part.
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    part = rows.where("__n < __all").withColumn("__turn", turn).where("__turn <= __n")
    return rows.where("__n = __all").select(*docs.columns).unionByName(part.select(*docs.columns))
