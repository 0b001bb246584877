"""Top-k lists per group, kept up to date by what changes.

A list holds more candidates than are shown, and the mark: the best place that any row outside the list can have. A changed row that beats the mark is
a candidate with its new score, one that does not needs no place. While a list's k-th candidate is not below the mark, its first k are
the true ones; only where scores fell so far that it is, the group is ranked anew from all its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, finished_versions
from .ranking import top_k

#: Candidates per shown row, and how many times that many a list may have before it is cut.
SPARE, GROWTH = 3, 2


@dataclass(frozen=True)
class KeptBoards:
    """Lists of the `k` rows of each group with the highest score, rows without a score last; among equals the higher id, or the lower.

    Rows are (`groups`, `id`, `score`); `groups` may be empty for a single list.
    """

    spark: SparkSession
    path: str
    groups: Sequence[str]
    k: int
    lower_id_first: bool = False

    @property
    def kept(self) -> int:
        return self.k * SPARE

    def _order(self) -> Column:
        """Greater for better rows, so that rows and marks compare as they are."""
        score = F.coalesce(F.col("score").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
        number = F.col("id").cast("bigint")
        return F.struct(score.alias("score"), (-number if self.lower_id_first else number).alias("id"))

    def _table(self, name: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/version={version}")

    def versions(self) -> list[int]:
        return finished_versions(self.spark, f"{self.path}/marks", "version")

    def _keys(self, rows: DataFrame) -> DataFrame:
        """A group column even where there is a single list."""
        return rows.withColumn("_group", F.struct(*self.groups) if self.groups else F.lit(0))

    def _listed(self, rows: DataFrame, marks: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame]:
        """The best `most` rows of each group, and the marks: the best of the others, or what it was before."""
        ranked = top_k(rows, ["_group"], [F.col("_order").desc()], most + 1, place="_place")
        best = ranked.filter(F.col("_place") <= most).drop("_place")
        cut = ranked.filter(F.col("_place") == most + 1).select("_group", F.col("_order").alias("_cut"))
        groups = rows.select("_group").distinct() if marks is None else rows.select("_group").unionByName(marks.select("_group")).distinct()
        found = groups.join(cut, "_group", "left")
        if marks is not None:
            found = found.join(marks, "_group", "left").withColumn("_cut", F.greatest("_cut", "_mark"))
        return best, found.select("_group", F.col("_cut").alias("_mark"))

    def _write(self, rows: DataFrame, marks: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/version={version}")
        marks.write.mode("overwrite").parquet(f"{self.path}/marks/version={version}")

    def create(self, everything: DataFrame) -> None:
        """Rank all rows."""
        rows = self._keys(everything.select(*self.groups, "id", "score")).withColumn("_order", self._order())
        self._write(*self._listed(rows, None, self.kept), 0)

    def update(self, changed: DataFrame, everything: Callable[[], DataFrame], version: int | None = None, gone: DataFrame | None = None) -> int:
        """Take in the rows that are new or have a new score, and leave out those of `gone` (`groups`, `id`); returns how many groups were ranked anew.

        `changed` has one row per id; `everything` is all rows with their scores after the change, read only for the groups to be ranked anew. A row never changes its
        group. A version that is there already is not written again.
        """
        before = self.versions()
        version = before[-1] + 1 if version is None else version
        if before[-1] >= version:
            return 0
        rows, marks = self._table("rows", before[-1]), self._table("marks", before[-1])
        fresh = self._keys(changed.select(*self.groups, "id", "score")).withColumn("_order", self._order())
        above = fresh.join(marks, "_group", "left").filter(F.col("_mark").isNull() | (F.col("_order") > F.col("_mark"))).drop("_mark")
        pool = rows.join(fresh.select("_group", "id"), ["_group", "id"], "left_anti").unionByName(above)
        if gone is not None:
            pool = pool.join(self._keys(gone).select("_group", "id"), ["_group", "id"], "left_anti")
        # The pool grows by what changed; it is cut to the candidates where it has become long.
        longest = self.kept * GROWTH
        best, found = self._listed(pool, marks, longest)
        folder = f"{self.path}/pool/version={version}"
        best.write.mode("overwrite").parquet(folder)
        found.write.mode("overwrite").parquet(f"{self.path}/pool-marks/version={version}")
        best, found = self.spark.read.schema(best.schema).parquet(folder), self._table("pool-marks", version)
        sizes = best.groupBy("_group").agg(F.count("*").alias("_n"))
        short = found.join(sizes, "_group", "left").filter(F.col("_mark").isNotNull() & (F.coalesce("_n", F.lit(0)) < self.k)).select("_group")
        n_short = short.count()
        if n_short:
            again = self._keys(everything().select(*self.groups, "id", "score")).withColumn("_order", self._order())
            anew, anew_marks = self._listed(again.join(short, "_group", "left_semi"), None, self.kept)
            best = best.join(short, "_group", "left_anti").unionByName(anew)
            found = found.join(short, "_group", "left_anti").unionByName(anew_marks)
        self._write(best, found, version)
        for name in ("rows", "marks", "pool", "pool-marks"):
            for old in before[:-1]:
                delete_folder(self.spark, f"{self.path}/{name}/version={old}")
        return n_short

    def shown(self) -> DataFrame:
        """(`groups`, place, id, score) of the first `k` rows of each group."""
        rows = self._table("rows", self.versions()[-1])
        best = top_k(rows, ["_group"], [F.col("_order").desc()], self.k, place="place")
        return best.select(*self.groups, "place", "id", "score")
