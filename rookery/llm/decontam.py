"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every 6 consecutive hashes of 5 words the smallest is a fingerprint, so any shared span of
10 words holds a fingerprint that both sides keep. Document fingerprints are joined with the benchmark's, and each hit is
extended to the windows of 10 words around it, which are compared as words: no hash decides
what counts. Items of fewer than 10 words are one window of their own length, and the same is done for each such length
with hashes short enough to keep the guarantee.

Fingerprints of documents stay narrow (row key, place, hash) and meet the benchmark's table, which is written first
so that Spark knows its size and broadcasts it only below its threshold; else the join is shuffled and hot hashes are split.
Texts are shuffled for documents with hits only, which a bitmap of fixed size tells from most others.

Defined results: null and empty texts and items have no words; items with the same window all count;
rows that repeat an id and a text have equal results; items with a null id count as hits and are in no list of items; an empty benchmark
leaves all documents clean; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, filled, marked, marks, row_key, settled, stored

#: Words in a window, and in what is hashed of it.
WINDOW = 10
GRAM = 5


def _plan(window: int) -> tuple[int, int]:
    """Words hashed together and hashes to choose from, so that every shared window keeps one in common."""
    gram = min(GRAM, window)
    return gram, window - gram + 1


def _grams(words: Column, size: int) -> Column:
    """The hash of each run of `size` words."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def _chosen(hashes: Column, among: int) -> Column:
    """The distinct hashes that are smallest of `among` consecutive ones."""
    if among == 1:
        return F.array_distinct(hashes)
    last = F.size(hashes) - among
    least = lambda i: F.least(*[F.get(hashes, i + k) for k in range(among)])
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), least))).otherwise(F.array().cast("array<bigint>"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, words) of each window, as one text."""
    items = benchmark.select("item_id", alnum_words(filled("text")).alias("words"))
    items = items.withColumn("length", F.least(F.lit(WINDOW), F.size("words"))).where("length > 0")
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    items = items.select("item_id", "length", "words", F.explode(starts).alias("start"))
    return items.select(F.col("item_id").cast("string").alias("item_id"), "length", F.array_join(F.slice("words", F.col("start"), F.col("length")), " ").alias("window")).distinct()


def benchmark_windows(spark: SparkSession, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """The windows (window, length, item_id), their fingerprints (length, hash) and the lengths there are."""
    windows = stored(spark, _windows(benchmark), "benchmark-windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # WINDOW at most
    prints = None
    for length in lengths:
        gram, among = _plan(length)
        words = F.split("window", " ")
        some = windows.where(F.col("length") == length).select("length", F.explode(_chosen(_grams(words, gram), among)).alias("hash")).distinct()
        prints = some if prints is None else prints.unionByName(some)
    if prints is None:
        prints = windows.select("length", F.lit(0).cast("long").alias("hash"))
    return windows, stored(spark, prints, "benchmark-fingerprints"), lengths


def matched_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each document's (key, doc_id, n_words), and the (key, start, length, item_id) where a benchmark window occurs."""
    windows, prints, lengths = benchmark_windows(spark, benchmark)
    each = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "doc_id", alnum_words(filled("text")).alias("words"))
    fields = ["key", "doc_id", F.size("words").cast("long").alias("n_words")]
    for length in lengths:
        gram, among = _plan(length)
        fields.append(_grams(F.col("words"), gram).alias(f"grams_{length}"))
    hashed = each.select("words", *fields)
    kept = [F.struct(F.lit(n).alias("length"), _chosen(F.col(f"grams_{n}"), _plan(n)[1]).alias("hashes")) for n in lengths]
    sketch = hashed.select("key", "doc_id", "n_words", F.array(*kept).alias("sketch") if kept else F.lit(None).alias("sketch"))
    if not lengths:
        none = windows.select(F.lit("").alias("key"), F.lit(0).alias("start"), "length", "item_id").where("false")
        return sketch.select("key", "doc_id", "n_words"), none
    sketch = stored(spark, sketch, "document-fingerprints")

    spread = sketch.select("key", F.explode("sketch").alias("s")).select("key", "s.length", F.explode("s.hashes").alias("hash"))
    hits = stored(spark, spread.join(prints, ["length", "hash"]).select("key", "length", "hash").distinct(), "hits")
    return sketch.select("key", "doc_id", "n_words"), _extended(spark, docs, hits, windows, lengths)


def _extended(spark: SparkSession, docs: DataFrame, hits: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows around the hits that are a benchmark window word by word."""
    found = hits.groupBy("key", "length").agg(F.collect_set("hash").alias("hashes"))  # at most a document's fingerprints
    # Dealt into as many buckets as each then holds, so that a very long document full of hits is looked up fast.
    n = F.ceil(F.sqrt(F.size("hashes"))).cast("int")
    buckets = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.filter("hashes", lambda h: F.pmod(h, n) == b))
    found = stored(spark, found.select("key", "length", buckets.alias("buckets")), "documents-with-hits")
    text = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "text")
    text = marked(text, "key", marks(spark, found.select("key"))).where("__marked").drop("__marked")
    parts = None
    for length in lengths:
        gram, among = _plan(length)
        some = text.join(found.where(F.col("length") == length).drop("length"), "key").dropDuplicates(["key"])
        some = some.select("key", "buckets", alnum_words(filled("text")).alias("words"))
        some = some.select("key", "buckets", "words", _grams(F.col("words"), gram).alias("grams"))

        def wanted(i: Column) -> Column:
            hash_ = F.get(F.col("grams"), i)
            return F.array_contains(F.get(F.col("buckets"), F.pmod(hash_, F.size("buckets")).cast("int")), hash_)

        places = F.filter(F.sequence(F.lit(0), F.size("grams") - 1), wanted)
        # Every window that holds the hit: it starts up to `among - 1` words before.
        around = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), p - (among - 1)), p))))
        around = F.filter(around, lambda s: s + length <= F.size("words"))
        spans = F.transform(around, lambda s: F.struct(s.alias("start"), F.array_join(F.slice("words", s + 1, length), " ").alias("window")))
        some = some.select("key", F.explode(spans).alias("s")).select("key", "s.start", F.lit(length).alias("length"), "s.window")
        parts = some if parts is None else parts.unionByName(some)
    return parts.join(windows, ["length", "window"]).select("key", "start", "length", "item_id")


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted (start, length) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, span: Column) -> Column:
        end = (span["start"] + span["length"]).cast("long")
        return F.struct((state["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(span["start"].cast("long"), state["end"]))).alias("n"), F.greatest(end, state["end"]).alias("end"))

    return F.aggregate(spans, start, add, lambda s: s["n"])


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key, doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    each, matches = matched_windows(spark, docs, benchmark)
    by_doc = matches.groupBy("key").agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("n_hit"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    by_doc = stored(spark, by_doc.select(F.col("key").alias("of"), "n_hit", "items"), "contaminated")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return each.join(by_doc, F.col("key") == F.col("of"), "left").select(
        "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with all columns, without the documents that hold a benchmark window."""
    bad = settled(spark, lambda: matched_windows(spark, docs, benchmark)[1].select(F.col("key").alias("__key")).distinct(), "contaminated")
    keyed = docs.withColumn("__key", row_key(F.col("doc_id"), F.xxhash64("text")))
    keyed = marked(keyed, "__key", marks(spark, bad))
    clean = keyed.where("NOT __marked").unionByName(keyed.where("__marked").join(bad, "__key", "left_anti"))
    return clean.select(*docs.columns)
