"""Tables kept in buckets, so that a change job reads and writes only those its batch touches.

    <path>/data/version=<v>/bucket=<b>/   the rows of bucket b, as version v wrote them
    <path>/manifest/version=<v>/          (bucket, of): the version that holds the rows of each bucket

A version is there once its manifest is written whole. It names the new folders of the touched buckets and the old ones of all others,
so readers of an older version are not disturbed, and a job that failed half way is simply run again. A version that is there already is
not written again: a streaming batch that is repeated changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.prefilter import bitmap_bits, id_bitmap, with_hit
from ..session import delete_folder, finished_versions

#: Joins with so few events broadcast them, and need no bitmap to shuffle little.
FEW_EVENTS = 10_000

Change = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class BucketedTable:
    """Rows of `schema` in buckets by the hash of `keys`.

    With `near`, a whole-number column such as an id that grows, a bucket holds a range of `width` of its values only (and `buckets` of them share
    each range): batches about recent rows then touch the newest ranges alone, whatever their keys.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    buckets: int
    near: str | None = None
    width: int = 1

    def _typed(self, keys: Sequence[str] | None = None) -> dict[str, Column]:
        names = dict(zip(self.keys, keys or self.keys))
        types = {f.name: f.dataType for f in StructType.fromDDL(self.schema)}
        # Equal keys of different types hash differently.
        return {k: F.col(n).cast(types[k]) for k, n in names.items()}

    def bucket(self, keys: Sequence[str] | None = None) -> Column:
        """The bucket of a row; `keys` are the names of its key columns where they differ."""
        typed = self._typed(keys)
        number = F.pmod(F.xxhash64(*typed.values()), F.lit(self.buckets))
        if self.near:
            number = F.coalesce(F.floor(typed[self.near] / self.width), F.lit(0)) * self.buckets + number
        return number.cast("bigint")

    def versions(self) -> list[int]:
        return finished_versions(self.spark, f"{self.path}/manifest", "version")

    def manifest(self, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket, at `version` or the latest: one entry per bucket, not per row."""
        there = [v for v in self.versions() if version is None or v <= version]
        if not there:
            return {}
        found = self.spark.read.schema("bucket bigint, of bigint").parquet(f"{self.path}/manifest/version={there[-1]}")
        return {r.bucket: r.of for r in found.collect()}

    def read(self, version: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows at `version` or the latest, of the buckets in `only` or all."""
        held = self.manifest(version)
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def touched(self, events: DataFrame, keys: Sequence[str] | None = None) -> set[int]:
        return {r.bucket for r in events.select(self.bucket(keys).alias("bucket")).distinct().collect()}

    def create(self, rows: DataFrame, version: int = 0) -> None:
        """Write all rows as the first version."""
        if self.versions():
            raise ValueError(f"{self.path} has versions already")
        self._write(rows, version, {})

    def merge(self, events: DataFrame, change: Change, version: int | None = None, keys: Sequence[str] | None = None, by_bucket: bool = False) -> int:
        """Write the next version, in which the buckets that `events` touch hold `change(rows, events)`.

        `change` leaves rows alone whose key no event has. Such rows are not handed to it but for a few, a bitmap tells them from the others, so that its joins shuffle
        little of the table; `events` are written first, as they are read several times. With `by_bucket` all rows are handed over, both frames name their `bucket`, and `change` leaves the rows of a bucket in one task: they
        are shuffled only there, for tables whose buckets are bounded. Returns the number of buckets that were rewritten.
        """
        there = self.versions()
        version = (there[-1] + 1 if there else 0) if version is None else version
        if there and there[-1] >= version:
            return 0
        passing = f"{self.path}/events/version={version}"
        if not by_bucket:
            events.write.mode("overwrite").parquet(passing)
            events = self.spark.read.schema(events.schema).parquet(passing)
        touched = self.touched(events, keys)
        held = self.manifest()
        rows, kept = self.read(only=touched), {b: v for b, v in held.items() if b not in touched}
        if by_bucket:
            rows, events = rows.withColumn("bucket", self.bucket()), events.withColumn("bucket", self.bucket(keys))
            changed = change(rows, events)
        else:
            changed = self._changed(rows, events, change, keys)
        self._write(changed, version, kept, placed=by_bucket)
        if not by_bucket:
            delete_folder(self.spark, passing)
        return len(touched)

    def _changed(self, rows: DataFrame, events: DataFrame, change: Change, keys: Sequence[str] | None) -> DataFrame:
        """`change(rows, events)`, of which only rows that may have an event take part in the change."""
        n = events.count()
        bits = bitmap_bits(n, least_bits=2)
        if bits is None or n <= FEW_EVENTS:
            return change(rows, events)
        asked = events.select(F.xxhash64(*self._typed(keys).values()).alias("_key"))
        flagged = with_hit(rows.withColumn("_key", F.xxhash64(*self._typed().values())), "_key", id_bitmap(asked, "_key", bits), bits)
        names = rows.columns
        return change(flagged.filter("_hit").select(*names), events).select(*names).unionByName(flagged.filter("NOT _hit").select(*names))

    def carry(self, version: int) -> None:
        """Make `version` the same as the one before it, without data of its own."""
        there = self.versions()
        if not there or there[-1] < version:
            self._note(version, self.manifest())

    def _write(self, rows: DataFrame, version: int, kept: dict[int, int], placed: bool = False) -> None:
        folder = f"{self.path}/data/version={version}"
        names = [f.name for f in StructType.fromDDL(self.schema)]
        if not placed:
            # Rebalancing puts a bucket into one file, and splits it where it is large.
            rows = rows.select(*names, self.bucket().alias("bucket")).hint("rebalance", "bucket")
        rows.select(*names, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = finished_versions(self.spark, folder, "bucket", marker=None)
        self._note(version, kept | dict.fromkeys(written, version))

    def _note(self, version: int, held: dict[int, int]) -> None:
        manifest = self.spark.createDataFrame([*held.items()], "bucket bigint, of bigint")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")

    def retire(self, before: int) -> None:
        """Delete the versions before `before` and the folders that only they hold. No reader may use them any more."""
        there = self.versions()
        kept = {(b, v) for version in there if version >= before for b, v in self.manifest(version).items()}
        for version in there:
            if version < before:
                delete_folder(self.spark, f"{self.path}/manifest/version={version}")
                for b in finished_versions(self.spark, f"{self.path}/data/version={version}", "bucket", marker=None):
                    if (b, version) not in kept:
                        delete_folder(self.spark, f"{self.path}/data/version={version}/bucket={b}")
