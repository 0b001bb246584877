"""Helpers that several operators share."""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, work_dir

#: The white space that separates words and is ignored around lines.
SPACES = " \t\n\x0b\x0c\r"


#: The folders written since `settled` began, while it runs.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def stored(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """`frame` written to the shared folder and read back.

    It cuts the lineage, survives lost executors, and lets later joins know the table's size.
    """
    path = work_dir(spark, f"llm-{name}")
    frame.write.parquet(path)
    if (passing := _passing.get()) is not None:
        passing.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """`make()` written and read back, with every table that was stored on the way deleted."""
    outer = _passing.get()
    token = _passing.set([])
    try:
        found = stored(spark, make(), name)
        *gone, kept = _passing.get()
        for path in gone:
            delete_folder(spark, path)
    finally:
        _passing.reset(token)
    if outer is not None:
        outer.append(kept)
    return found


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Let what is written inside send Python workers at most `rows` rows at a time.

    A worker and its executor each hold such a batch and what is made of it, several times over, outside the JVM's heap.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(rows, before) if before > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On machines without that folder it changes nothing; there the package has to be installed or given by `--py-files`.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def filled(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are.

    `lower` does that to texts of ASCII only, several times as fast as `translate`.
    """
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def alnum_words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, with A-Z in lower case."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def row_key(*parts: Column) -> Column:
    """One text that names a row: its id (nothing for null) and what else tells rows apart."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


#: Bits per marked key, least and most bits of all bitmaps (a broadcast of at most 32 MB whatever the data), and bits of one bitmap.
BITS_PER_KEY, LEAST_MARKS, MOST_MARKS, MARKS_PER_MAP = 16, 1 << 22, 1 << 28, 1 << 15


@dataclass(frozen=True)
class Marks:
    """Bitmaps (map, bits) over the hashes of keys, and how many bits there are in all."""

    bitmaps: DataFrame
    bits: int


def marks(spark: SparkSession, keys: DataFrame) -> Marks:
    """The bitmaps of the one column of `keys`, sized by its rows. Beyond the most bits more other rows are marked, and nothing else changes."""
    bits = min(MOST_MARKS, max(LEAST_MARKS, 1 << (keys.count() * BITS_PER_KEY).bit_length()))
    number = F.pmod(F.xxhash64(keys.columns[0]), F.lit(bits))
    places = keys.select(F.floor(number / MARKS_PER_MAP).alias("map"), (number % MARKS_PER_MAP).alias("bit"))
    return Marks(stored(spark, places.groupBy("map").agg(F.bitmap_construct_agg("bit").alias("bits")), "marks"), bits)


def marked(frame: DataFrame, key: str, known: Marks) -> DataFrame:
    """`frame` with a column `__marked`: whether the row's key may be among the marked ones.

    Rows that are not marked need no exact join, and where that join carries texts, theirs are not shuffled.
    """
    rows = frame.withColumn("__number", F.pmod(F.xxhash64(key), F.lit(known.bits)))
    maps = F.broadcast(known.bitmaps.toDF("__map", "__bits"))
    rows = rows.join(maps, F.floor(F.col("__number") / MARKS_PER_MAP) == F.col("__map"), "left")
    place = (F.col("__number") % MARKS_PER_MAP).cast("int")
    byte = F.conv(F.hex(F.substr("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))
    return rows.withColumn("__marked", hit).drop("__number", "__map", "__bits")
