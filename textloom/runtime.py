"""Session helpers: the shared folder for written intermediate tables, and lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, notebooks in local mode) is a folder of our own made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return "file://" + _OWN[app]


_WRITTEN: list[str] = []


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that this process has written in the shared folder; call it once results are stored."""
    while _WRITTEN:
        drop_path(spark, _WRITTEN.pop())


def written_so_far() -> int:
    """A mark for ``drop_written_since``."""
    return len(_WRITTEN)


def drop_written_since(spark: SparkSession, mark: int) -> None:
    """Deletes the tables written since the mark."""
    while len(_WRITTEN) > mark:
        drop_path(spark, _WRITTEN.pop())


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of ids or hashes (some 16 bytes each) that are sent to every worker.
BROADCAST_IDS = 4_000_000


def sent_if_small(table: DataFrame) -> DataFrame:
    """A written table of ids or hashes, to be broadcast if it has at most BROADCAST_IDS rows; joined by shuffle beyond."""
    return broadcast(table) if table.count() <= BROADCAST_IDS else table


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, which gives the memory it has freed back to the system at its end.

    Workers are kept for later tasks, more of them than there are cores where a task has several Python steps; what
    each would hold on to adds up to hundreds of MB of an executor.
    """

    def with_release(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return with_release


#: Items of lists that a worker handles at once; bounds its temporary arrays, whatever rows a batch has.
ITEMS_AT_ONCE = 1 << 18


def cut(batch: pa.RecordBatch, sizes: np.ndarray, limit: int = ITEMS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Cuts a record batch so that the ``sizes`` of each piece's rows add up to about ``limit`` at most (one row may have more)."""
    part = (np.cumsum(sizes) - sizes) // limit
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(ends, ends[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table through Hadoop's file system API, so any scheme works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(table: DataFrame) -> None:
    """Deletes a table that ``materialise`` has written, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        drop_path(table.sparkSession, path)


def require(df: DataFrame, *columns: str) -> None:
    """Raises with the names that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; the table has {df.columns}")


#: A core's share of a table up to which ``spread`` thinks of it as small.
SMALL_SHARE = 64 << 20


def partitions(spark: SparkSession) -> int:
    """Partitions for rows that cost much each: enough for all cores, whatever their bytes."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """A small table of fewer files than cores, hashed over all cores; any other table as it is.

    A file of one row group is read by one task, however small the splits. Large tables have row groups enough, and
    are never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not 0 < len(df.inputFiles()) < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores, key or df.columns[0]) if 1 << 20 < size < cores * SMALL_SHARE else df
