"""Line dedup with two Bloom filters.

A first read sets one filter for line hashes seen once and one for those seen again. Both are sized by a count of all lines,
`BITS_PER_LINE` for each, up to `MOST_BITS`, so what is merged and broadcast is bounded whatever the input; where they fill up beyond that, more lines
are suspected, and nothing else changes. A second read tests each line against the second filter, and only suspected lines
go on: their SHA-256 is shuffled with the document's id to confirm that two documents hold it and
to choose the smallest id. Texts are read a third time, and only those that lose lines are joined with their lists of lines to drop.

Each task merges its own filters; the parts of a filter meet by segment, streamed, so a merging task holds
a segment or a few and not one filter per task. A line that a third of all documents hold is one row per map task
where it is confirmed, and its rows are split by adaptive execution where it is joined back, as that join reads written tables.

Defined results: null and empty texts are one empty line; a line repeated within one document counts
once and keeps or loses all its places; rows without an id keep all lines and count for no other document;
rows that repeat an id are one document; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, filled, marked, marks, row_key, stored

#: Lines whose key has fewer code points stay.
LEAST_POINTS = 10
#: Bits of each filter per line of the input, its least and most bits (64 MB), bits set per line, and segments in which filters are merged.
BITS_PER_LINE = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
PROBES = 3
SEGMENTS = 64

_STRIP = SPACES.encode()


def line_key(line: bytes) -> bytes | None:
    """What makes lines equal, or None for a line too short to be dropped."""
    key = line.strip(_STRIP).lower()
    if len(key) < LEAST_POINTS or len(key) < 4 * LEAST_POINTS and len(key.decode()) < LEAST_POINTS:
        return None
    return key


def _keys(text: bytes) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if k is not None}


def _texts(column: pa.Array) -> Iterable[bytes]:
    return (t.as_py() or b"" for t in column.cast(pa.binary()))


def _places(keys: Iterable[bytes], bits: int) -> np.ndarray:
    """Each key's bits, one row per key."""
    hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)], axis=1)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _put(bitmap: np.ndarray, places: np.ndarray) -> None:
    flat = places.ravel()
    np.bitwise_or.at(bitmap, flat >> np.uint64(3), np.left_shift(1, (flat & np.uint64(7)).astype(np.uint8)).astype(np.uint8))


def _filters_of_task(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found = [k for text in _texts(batch.column(0)) for k in _keys(text)]
            if not found:
                continue
            places, counts = np.unique(_places(found, bits), axis=0, return_counts=True)
            _put(twice, places[(counts > 1) | _has(once, places)])
            _put(once, places)
        size = len(once) // SEGMENTS
        for s in range(SEGMENTS):
            parts = [b[s * size : (s + 1) * size] for b in (once, twice)]
            if parts[0].any():
                yield pa.RecordBatch.from_pydict({"segment": [s], "once": [zlib.compress(parts[0], 1)], "twice": [zlib.compress(parts[1], 1)]})

    return run


def _merge_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            s = batch.column(0)[row].as_py()
            once, twice = (np.frombuffer(zlib.decompress(batch.column(i)[row].as_py()), np.uint8) for i in (1, 2))
            if s not in merged:
                merged[s] = [once.copy(), twice.copy()]
            else:
                have = merged[s]
                have[1] |= twice | (have[0] & once)
                have[0] |= once
    for s, (_, twice) in merged.items():
        yield pa.RecordBatch.from_pydict({"segment": [s], "twice": [zlib.compress(twice, 1)]})


def filter_bits(docs: DataFrame) -> int:
    """Bits of each filter for all lines of the texts."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    n_lines = docs.agg(F.sum(breaks)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (n_lines * BITS_PER_LINE).bit_length()))


def seen_twice(docs: DataFrame, bits: int) -> bytes:
    """The filter of the line hashes that may be in two documents."""
    parts = docs.select("text").mapInArrow(_filters_of_task(bits), "segment long, once binary, twice binary")
    merged = parts.repartition(SEGMENTS, "segment").mapInArrow(_merge_segments, "segment long, twice binary")
    bitmap = bytearray(bits // 8)
    size = bits // 8 // SEGMENTS
    for row in merged.collect():  # a fixed number of segments of a fixed size
        bitmap[row.segment * size : (row.segment + 1) * size] = zlib.decompress(row.twice)
    return bytes(bitmap)


def _suspects(filter_bytes, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(filter_bytes.value, np.uint8)
        for batch in batches:
            per_text = [list(_keys(text)) for text in _texts(batch.column(1))]
            flat = [k for keys in per_text for k in keys]
            if not flat:
                continue
            hit = iter(_has(bitmap, _places(flat, bits)).tolist())
            found = [[hashlib.sha256(k).digest() for k in keys if next(hit)] for keys in per_text]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "suspects"])
            yield out.filter(pa.array([bool(f) for f in found]))

    return run


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, dropped = [], []
        for text, drops in zip(_texts(batch.column(1)), batch.column(2)):
            drop = set(drops.as_py())
            lines = text.split(b"\n")
            kept = [x for x in lines if (k := line_key(x)) is None or hashlib.sha256(k).digest() not in drop]
            texts.append(b"\n".join(kept).decode())
            dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(dropped, pa.int64())], names=["key", "kept_text", "n_dropped"])


def _key() -> F.Column:
    return row_key(F.col("doc_id"), F.xxhash64("text"))


def rewritten(spark: SparkSession, docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(key, kept_text, n_dropped) of the documents that lose lines; `key` names the row."""
    bits = bits or filter_bits(docs)
    twice = spark.sparkContext.broadcast(seen_twice(docs, bits))
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("doc_id IS NOT NULL").select(_key().alias("key"), "doc_id", "text")
    suspected = stored(spark, known.select("doc_id", "text").mapInArrow(_suspects(twice, bits), f"doc_id {kind}, suspects array<binary>"), "suspects")
    lines = suspected.select("doc_id", F.explode("suspects").alias("line"))
    repeated = lines.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = stored(spark, repeated.where("first != last").select("line", "first"), "repeated-lines")
    drops = lines.join(repeated, "line").where("doc_id != first").select("doc_id", "line")
    drops = stored(spark, drops.groupBy("doc_id").agg(F.collect_set("line").alias("drops")), "drops")  # at most a document's lines
    losing = marked(known, "doc_id", marks(spark, drops.select("doc_id"))).where("__marked").join(drops, "doc_id").select("key", "text", "drops")
    kept = losing.mapInArrow(_rewrite, "key string, kept_text string, n_dropped long")
    return stored(spark, kept.dropDuplicates(["key"]), "rewritten")


def dedup_lines(spark: SparkSession, docs: DataFrame, bits: int | None = None) -> DataFrame:
    """`docs` with all columns, without the lines that an earlier document holds."""
    new = rewritten(spark, docs, bits).select(F.col("key").alias("__key"), F.col("kept_text").alias("__kept"))
    text = F.when(F.col("__kept").isNotNull(), F.col("__kept")).otherwise(F.col("text"))
    return docs.withColumn("__key", _key()).join(new, "__key", "left").withColumn("text", text).select(*docs.columns)


def line_counts(spark: SparkSession, docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of each document."""
    new = rewritten(spark, docs, bits).select(F.col("key").alias("of"), "n_dropped", F.sha2("kept_text", 256).alias("new_sha"))
    text = filled("text")
    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    each = docs.select("doc_id", _key().alias("key"), n_lines.alias("n_lines"), F.sha2(text, 256).alias("old_sha"))
    each = each.join(new, F.col("key") == F.col("of"), "left")
    return each.select("doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("new_sha", "old_sha").alias("kept_sha256"))
