"""Token counts of a byte-level BPE, with huge documents encoded in overlapping chunks.

Documents of up to `CHUNK` characters are encoded whole. Longer ones are cut into chunks that overlap, each chunk is
encoded by itself wherever a task is free, and neighbours are spliced where both have a token boundary that is proven
stable: between a character that is no white space and an ASCII white space. The tokenizer first splits texts
by a pattern, none of whose parts can hold white space after anything else, and it merges bytes only within those parts, so
such a place is a boundary in every text around it. Each chunk then counts from its first splice to its last. A
document with a pair of chunks that share no such place is cut again with chunks and overlaps `WIDEN` times as long,
up to the whole document.

Encoding uses the ranks file of the same vocabulary, several times as fast as the library of the JSON file;
tests compare the two by code point and on random texts. Strings of added tokens in a text are one token each, the library's default.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows that repeat an id and a text have equal counts;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filled, row_key, stored

LIMIT = 512
#: Characters of a chunk without and of its overlap with the next, and their growth when neighbours cannot be spliced.
CHUNK, OVERLAP, WIDEN = 1 << 14, 1 << 9, 8
#: The pattern that splits a text before bytes are merged; a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of one kind of character beyond this go to the JSON file's library, which has no limit on them.
RUN = 50_000
LONG_RUN = re.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")
STABLE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def paths() -> tuple[str, str]:
    """The JSON file and the ranks file of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, json_path: str, ranks_path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        with open(json_path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.whole = Tokenizer.from_file(json_path)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.lengths[number] = len(token)
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text around added tokens, and those tokens."""
        parts = self.added.split(text) if self.added else [text]
        return ((p, i % 2 == 1) for i, p in enumerate(parts) if p)

    def count(self, text: str) -> int:
        if len(text) >= RUN and LONG_RUN.search(text):
            return len(self.whole.encode(text, add_special_tokens=False))
        return sum(1 if added else len(self.fast.encode_ordinary(p)) for p, added in self.pieces(text))

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token ends, rising."""
        if len(text) >= RUN and LONG_RUN.search(text):
            return np.array([len(text[:e].encode()) for e in sorted(b for _, b in self.whole.encode(text, add_special_tokens=False).offsets)], np.int64)
        sizes = [np.array([len(p.encode())]) if added else self.lengths[self.fast.encode_ordinary(p)] for p, added in self.pieces(text)]
        return np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, np.int64)


@functools.cache
def encoder(json_path: str, ranks_path: str) -> Encoder:
    return Encoder(json_path, ranks_path)


def _whole(files: tuple[str, str], chunk: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(*files).count
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            counts = [count(t) if len(t) <= chunk else None for t in texts]
            long = [t if n is None else None for t, n in zip(texts, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array(long, pa.string())], names=["key", "doc_id", "n_bytes", "n_tokens", "long_text"])

    return run


def _cut(chunk: int, overlap: int) -> Callable:
    """One row per chunk: its number, the byte it starts at, its text and whether it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text, start = key.as_py(), text.as_py(), 0
                for number, at in enumerate(range(0, len(text), chunk)):
                    last = at + chunk >= len(text)
                    yield pa.RecordBatch.from_pydict({"key": [key], "number": pa.array([number], pa.int64()), "start": pa.array([start], pa.int64()), "piece": [text[at : at + chunk + overlap]], "last": [last]})
                    start += len(text[at : at + chunk].encode())

    return run


def _encoded(files: tuple[str, str], chunk: int, overlap: int) -> Callable:
    """Each chunk's tokens, and how many lie before each stable boundary of its two overlaps."""

    def bounds(text: str, ends: np.ndarray, start: int, low: int, high: int) -> list[dict]:
        before = len(text[:low].encode())
        found, at = [], low
        for m in STABLE.finditer(text, max(low, 1), high):
            before += len(text[at : m.start()].encode())
            at = m.start()
            n = int(np.searchsorted(ends, before, side="right"))
            if n and ends[n - 1] == before:
                found.append({"at": start + before, "n": n})
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*files)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            rows = {"n": [], "head": [], "tail": []}
            for row in range(batch.num_rows):
                start, text = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                ends = enc.ends(text)
                rows["n"].append(len(ends))
                rows["head"].append(bounds(text, ends, start, 0, min(overlap, len(text))))
                rows["tail"].append(bounds(text, ends, start, chunk, len(text)) if len(text) > chunk else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(rows["n"], pa.int64()), pa.array(rows["head"], kind), pa.array(rows["tail"], kind)], names=["key", "number", "last", "n", "head", "tail"])

    return run


def _spliced(chunks: DataFrame) -> DataFrame:
    """(key, n_tokens) of each document; null where a pair of neighbours shares no stable boundary."""
    tails = chunks.where("NOT last").select("key", "number", F.explode("tail").alias("t")).select("key", "number", F.col("t.at").alias("at"), F.col("t.n").alias("until"))
    heads = chunks.select("key", (F.col("number") - 1).alias("number"), F.explode("head").alias("h")).select("key", "number", F.col("h.at").alias("at"), F.col("h.n").alias("since"))
    cuts = tails.join(heads, ["key", "number", "at"]).groupBy("key", "number").agg(F.min(F.struct("at", "until", "since")).alias("cut"))
    sums = cuts.groupBy("key").agg(F.count("*").alias("n_cuts"), F.sum(F.col("cut.until") - F.col("cut.since")).alias("n_cut"))
    totals = chunks.groupBy("key").agg(F.count("*").alias("n_chunks"), F.sum(F.when(F.col("last"), F.col("n"))).alias("n_last"))
    n_tokens = F.when(F.coalesce("n_cuts", F.lit(0)) == F.col("n_chunks") - 1, F.col("n_last") + F.coalesce("n_cut", F.lit(0)))
    return totals.join(sums, "key", "left").select("key", n_tokens.alias("n_tokens"))


def long_counts(spark: SparkSession, texts: DataFrame, files: tuple[str, str], chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of the long documents in (key, long_text), whose keys are distinct."""
    done = None
    while True:
        pieces = texts.mapInArrow(_cut(chunk, overlap), "key string, number long, start long, piece string, last boolean")
        pieces = pieces.repartition("key", "number")
        chunks = pieces.mapInArrow(_encoded(files, chunk, overlap), "key string, number long, last boolean, n long, head array<struct<at:long,n:long>>, tail array<struct<at:long,n:long>>")
        counted = stored(spark, _spliced(stored(spark, chunks, "chunks")), "spliced")
        done = counted if done is None else done.where("n_tokens IS NOT NULL").unionByName(counted)
        failed = counted.where("n_tokens IS NULL").select("key")
        if not failed.take(1):
            return done
        texts = stored(spark, texts.join(failed, "key", "left_semi"), "to-widen")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(spark: SparkSession, docs: DataFrame, files: tuple[str, str] | None = None, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document."""
    files = files or paths()
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "doc_id", filled("text").alias("text"))
    each = stored(spark, texts.mapInArrow(_whole(files, chunk), f"key string, doc_id {kind}, n_bytes long, n_tokens long, long_text string"), "token-counts")
    long = stored(spark, each.where("n_tokens IS NULL").select("key", "long_text").dropDuplicates(["key"]), "long-texts")
    found = long_counts(spark, long, files, chunk, overlap).select(F.col("key").alias("of"), F.col("n_tokens").alias("spliced"))
    n = F.coalesce("n_tokens", "spliced")
    each = each.select("key", "doc_id", "n_bytes", "n_tokens").join(found, F.col("key") == F.col("of"), "left")
    return each.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
