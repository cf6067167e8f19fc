"""Shared folder, checkpoints and range bounds used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"

CHECKPOINT_DIR = "spark.checkpoint.dir"


#: Tables that this process wrote with ``stored`` and hasn't deleted, by name.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode (tests) a temporary one where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get(CHECKPOINT_DIR) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that the executors share")
        named = tempfile.mkdtemp(prefix="stormlake-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of the JVM."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _until_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends."""
    store, found = _store(spark, path)
    store.mkdirs(found)
    store.deleteOnExit(found)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more, once their results are checkpointed."""
    gc.collect()
    spark._jvm.System.gc()


def trim_memory() -> None:
    """Give back to the system what a worker's allocators hold free. A worker lives on from group to group, and its two allocators, Arrow's and
    the C library's, would each keep the most that any group took of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a table of the shared folder and read it again: compressed, for rows with texts. It goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _until_exit(spark, path)
    _WRITTEN.setdefault(name, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(name: str, unless: DataFrame) -> None:
    """Delete the tables that this process has ``stored`` under a name, but for those that a DataFrame still reads."""
    read = unless.inputFiles()
    kept = []
    for path in _WRITTEN.pop(name, []):
        if any(urlparse(path).path in x for x in read):
            kept.append(path)
        else:
            store, found = _store(unless.sparkSession, path)
            store.delete(found, True)
    if kept:
        _WRITTEN[name] = kept


def mounted_dir(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one as a path that workers can map into memory. It goes when the driver ends."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"{CHECKPOINT_DIR} must be a mounted folder to map arrays from it: {url.scheme}")
    path = f"{url.path}/{name}-{uuid.uuid4().hex}"
    _until_exit(spark, f"file://{path}")
    return path


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` values of an integer column that cut it into ranges of like size; the first is the minimum."""
    if parts < 1:
        raise ValueError("parts must be positive")
    cuts = [i / parts for i in range(1, parts)]
    row = df.agg(F.min(key).alias("least"), *([F.percentile_approx(key, cuts).alias("cuts")] if cuts else [])).first()
    if row is None or row["least"] is None:
        return []
    return sorted({row["least"], *(row["cuts"] if cuts else ())})


def bucket_of(key: str, bounds: list[int]) -> Column:
    """Index of the last bound that isn't above the key, found by bisection in a nested CASE."""

    def cut(lo: int, hi: int) -> str:
        if hi - lo == 1:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {key} < {bounds[mid]}L THEN {cut(lo, mid)} ELSE {cut(mid, hi)} END"

    return F.expr(cut(0, max(1, len(bounds)))).cast("int")
