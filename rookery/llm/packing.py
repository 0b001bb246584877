"""Packing documents into sequences by sums of squares.

A document is its tokens and an end token. Longer ones than a sequence are cut into whole sequences, but for a shorter first
piece, so only pieces shorter than a sequence have to be packed. They are dealt at random into groups of about `GROUP`, and a
group needs no more than its number of pieces of each length: the longest pieces go first, each to the open
sequence where the sum of the squared numbers of open sequences per residual gap becomes smallest, and a
sequence is opened where a piece fits in none. A group gives each length its slots, and a group's n-th piece of a length takes the n-th slot.
Each group leaves a few sequences unfilled, whatever the number of groups; no task sees more than a group.

Pieces are numbered when they are written, so copies and rows without an id are spread like all others, and a repeated task
packs as before.

Defined results: null and empty texts are one piece, the end token alone; rows that repeat an id have pieces of
their own; an empty table packs into nothing; other columns of `docs` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filled, stored
from .token_counts import LONG_RUN, RUN, STABLE, Encoder, encoder, paths

#: Tokens of a sequence, and the token that ends a document.
SIZE, END = 1024, 2
#: Pieces of a group, on average.
GROUP = 1 << 16
#: Characters encoded at a time, up to the next place where tokens surely end.
PART = 1 << 20


def token_ids(enc: Encoder, text: str) -> np.ndarray:
    """The tokens of a text as the JSON file's library gives them."""
    found = []
    at = 0
    while at < len(text):
        end = STABLE.search(text, at + PART)
        part = text[at : end.start() if end else len(text)]
        at += len(part)
        if len(part) >= RUN and LONG_RUN.search(part):
            found.append(np.array(enc.whole.encode(part, add_special_tokens=False).ids, "<u4"))
            continue
        for piece, added in enc.pieces(part):
            found.append(np.array([enc.whole.token_to_id(piece)], "<u4") if added else enc.fast.encode_to_numpy(piece, disallowed_special=()))
    return np.concatenate(found).astype("<u4", copy=False) if found else np.zeros(0, "<u4")


def _cut(files: tuple[str, str], size: int, end: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(*files)
        for batch in batches:
            rows = {"of": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for row, text in enumerate(batch.column(1)):
                ids = np.append(token_ids(enc, text.as_py()), np.array([end], "<u4")).astype("<u4", copy=False)
                first = (len(ids) - 1) % size + 1
                for piece, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], range(first, len(ids) + 1, size))):
                    own = ids[a:b]
                    values = (row, piece, a, b - a, zlib.crc32(own.tobytes()), own.tolist() if with_ids else None)
                    for column, value in zip(rows.values(), values):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(rows.pop("of"), pa.int64())), pa.array(rows.pop("piece"), pa.int32())]
            ids = pa.array(rows.pop("ids"), pa.list_(pa.int64()))
            columns += [pa.array(v, pa.int64()) for v in rows.values()] + [ids] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", *rows] + ["ids"] * with_ids)

    return run


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of all pieces, and their `ids` if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", filled("text").alias("text")).mapInArrow(_cut(files or paths(), size, end, with_ids), schema)


def pack_lengths(counts: dict[int, int], size: int) -> Iterator[tuple[int, int, int]]:
    """(length, sequence, offset) of a place for each piece, from the number of pieces of each length below `size`."""
    opened = np.zeros(size + 1, np.int64)  # open sequences per gap; none has no gap
    holders: dict[int, list[int]] = {}  # and which these are
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            # Taking a gap leaves one less of it and one more of the rest, if there is a rest.
            rest, gaps = opened[: size - length], opened[length:size]
            change = 2 * (rest - gaps) + 2
            change[:1] -= 1
            change[gaps == 0] = np.iinfo(np.int64).max
            best = int(change.argmin()) if len(change) else 0
            if len(change) and gaps[best]:
                gap = length + best
                opened[gap] -= 1
                sequence = holders[gap].pop()
            else:
                gap, sequence, n = size, n, n + 1
            if gap > length:
                opened[gap - length] += 1
                holders.setdefault(gap - length, []).append(sequence)
            yield length, sequence, size - gap


def _slots(size: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(of_group: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(of_group["length"].tolist(), of_group["n"].tolist()))
        slots = pd.DataFrame(pack_lengths(counts, size), columns=["length", "sequence", "offset"], dtype="int64")
        group = int(of_group["group"].iloc[0])
        slots.insert(0, "group", group)
        slots["turn"] = slots.groupby("length").cumcount() + 1
        slots["sequence_id"] = (group << 32) + slots.pop("sequence")
        return slots[["group", "length", "turn", "sequence_id", "offset"]]

    return run


def pack(spark: SparkSession, docs: DataFrame, size: int = SIZE, end: int = END, files: tuple[str, str] | None = None, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces, and their `ids` if asked for."""
    cut = pieces(docs, size, end, files, with_ids).withColumn("__place", F.monotonically_increasing_id())
    cut = stored(spark, cut, "pieces")
    short = cut.where(F.col("length") < size)
    groups = -(-short.count() // group) or 1
    short = short.withColumn("group", F.pmod(F.xxhash64("__place"), F.lit(groups)))
    counts = short.groupBy("group", "length").agg(F.count("*").alias("n"))
    slots = counts.groupBy("group").applyInPandas(_slots(size), "group long, length long, turn long, sequence_id long, offset long")
    turn = F.row_number().over(Window.partitionBy("group", "length").orderBy("__place")).cast("long")
    # There are as many slots as pieces, whatever Spark takes the size of the packed groups for.
    packed = short.withColumn("turn", turn).join(slots.hint("merge"), ["group", "length", "turn"])
    # A whole sequence needs no place among others.
    whole = cut.where(F.col("length") == size).withColumn("sequence_id", -1 - F.col("__place")).withColumn("offset", F.lit(0).cast("long"))
    columns = [c for c in cut.columns if c != "__place"] + ["sequence_id", "offset"]
    return packed.select(*columns).unionByName(whole.select(*columns))


def sequences(spark: SparkSession, docs: DataFrame, size: int = SIZE, end: int = END, files: tuple[str, str] | None = None, group: int = GROUP) -> DataFrame:
    """(sequence_id, ids) of the packed sequences, each of at most `size` tokens."""
    packed = pack(spark, docs, size, end, files, True, group)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
