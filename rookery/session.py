"""Session settings, the shared work folder and tables written once per application."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are written for. Adaptive execution splits hot join
# partitions; forcing it keeps the split even where it costs one more shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Streaming state lives on disk, not on the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Top-k of any k is cut before its shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "2147483647",
    # Call sites in error messages cost several round trips per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "rookery", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the recommended settings; `extra` keys use `__` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the application's own in the session's `spark.checkpoint.dir`; `discard_work` deletes them all.

    Only a session whose one process is the whole cluster may lack that setting; its folder is
    temporary and removed at exit. Executors of a cluster could not see such a folder.
    """
    return f"{_application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _application_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _own_folder().name
    return f"{base.rstrip('/')}/rookery/{spark.sparkContext.applicationId}"


def discard_work(spark: SparkSession) -> None:
    """Delete everything this application wrote below its work folder. Frames that read it cannot be used any more."""
    delete_folder(spark, _application_dir(spark))
    for key in [k for k in _WRITTEN if k[0] == spark.sparkContext.applicationId]:
        del _WRITTEN[key]


@cache
def _own_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="rookery-")


def folder_state(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of what lies in a folder: it changes when the tables there do."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    return ";".join(sorted(f"{f.getPath().getName()} {f.getLen()} {f.getModificationTime()}" for f in files))


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished_versions(spark: SparkSession, path: str, name: str, marker: str | None = "_SUCCESS") -> list[int]:
    """The numbers n of the folders `<path>/<name>=<n>`, rising; only of those that hold `marker`, which Spark writes last."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith(f"{name}=")]
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName().split("=")[1]) for p in found if marker is None or files.exists(hadoop_path(p, marker)))


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, files = _folder(spark, path)
    files.delete(folder, True)


_WRITTEN: dict[tuple[str, ...], str] = {}


def written_folder(spark: SparkSession, key: tuple[str, ...], write: Callable[[str], None]) -> str:
    """The folder `write` filled for `key`; it is called once per application."""
    full_key = (spark.sparkContext.applicationId, *key)
    if full_key not in _WRITTEN:
        folder = work_dir(spark, key[-1])
        write(folder)
        _WRITTEN[full_key] = folder
    return _WRITTEN[full_key]


def written_table(spark: SparkSession, key: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """`make()` as a table written once per application, which later queries read back."""
    return spark.read.parquet(written_folder(spark, key, lambda path: make().write.parquet(path)))
