"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from threading import Lock
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_open_lists: list[list[str]] = []
# when the last sweep ended, what it took, and the share of the time that sweeps may take
_sweeping, _last_sweep, SWEEP_SHARE = Lock(), [float("-inf"), 0.0], 0.2


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citestat")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CITESTAT_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back
    to a folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="citestat-")
    return _local_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/citestat/{name}-{uuid.uuid4().hex}"


def save_and_reload(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a result feeds several later steps or a loop: the plan restarts at a table
    that outlives any executor, and the work above it runs once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for held in _open_lists:
        held.append(path)
    df.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    _folders[saved] = path
    return saved


@contextmanager
def saved_tables() -> Iterator[list[str]]:
    """Collects the folders that `save_and_reload` makes inside the block, for `delete_tables`."""
    held: list[str] = []
    _open_lists.append(held)
    try:
        yield held
    finally:
        _open_lists[:] = [x for x in _open_lists if x is not held]


def delete_tables(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete saved tables that no frame in use reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def result_only(spark: SparkSession, job: Callable[[], DataFrame], name: str = "result") -> DataFrame:
    """The saved result of ``job``. All other tables that it saved are deleted, also when it fails."""
    with saved_tables() as made:
        try:
            out = save_and_reload(job(), name)
            made.remove(_folders[out])
        finally:
            delete_tables(spark, made)
    return out


def kept_by(df: DataFrame, *keys: str) -> DataFrame:
    """Partition and sort by key once and keep the result on the executors, spilling to disk.

    Loops join such a table every round without shuffling or sorting it again. A lost
    executor's partitions are made again from the saved table below; the caller unpersists.
    """
    placed = spread(df, *keys).sortWithinPartitions(*keys)
    return placed.persist(StorageLevel.MEMORY_AND_DISK)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by key into the full number of shuffle partitions.

    For steps that cost much computation per byte: adaptive execution would merge their
    small partitions and leave most cores idle.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)


def shuffle_width(spark: SparkSession) -> int:
    """The session's shuffle partitions; in one process not many more than its cores."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return min(width, 2 * spark.sparkContext.defaultParallelism)
    return width


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame made by `save_and_reload` (loops drop old rounds)."""
    folder = _folders.pop(df, None)
    if folder is not None:
        delete_tables(df.sparkSession, [folder])


def as_saved(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` itself if it is a table of `save_and_reload`, else `save_and_reload` of it."""
    return df if df in _folders else save_and_reload(df, name)


def sweep(spark: SparkSession, now: bool = False) -> None:
    """Let Spark delete the shuffle files of finished rounds.

    Executors keep them until the driver's collector finds that nothing uses them, which a driver with little to do
    may put off for hours. Loops of many rounds ask for it here, as often as it stays a small part of the time;
    ``now`` asks for it whatever the time, after one of a few large steps.
    """
    if not _sweeping.acquire(blocking=False):
        return
    try:
        begin = time.monotonic()
        if not now and (begin - _last_sweep[0]) * SWEEP_SHARE < _last_sweep[1]:
            return
        spark.sparkContext._jvm.System.gc()
        end = time.monotonic()
        _last_sweep[:] = end, end - begin
    finally:
        _sweeping.release()
