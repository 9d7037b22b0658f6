"""What the operators share: where staged tables live, and how they are released."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Spark deletes the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Staged tables of this driver process, by tag.
_staged: dict[str, list[str]] = {}
_lock = threading.Lock()
_local = threading.local()


@contextmanager
def tagged(tag: str):
    """What this thread stages inside carries ``tag``, so that it can be released apart from the rest."""
    before = getattr(_local, "tag", "llm")
    _local.tag = tag
    try:
        yield
    finally:
        _local.tag = before


def _remember(path: str) -> None:
    with _lock:
        _staged.setdefault(getattr(_local, "tag", "llm"), []).append(path)


def trim() -> None:
    """Give what a worker has freed back to the system, at the end of a task that held large arrays: workers are reused."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder is made and set, but only if the
    session runs on this machine alone: on a cluster executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        root = "file://" + tempfile.mkdtemp(prefix="vaultspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, remembered for :func:`release`."""
    path = f"{shared_root(spark)}/vaultspark/{name}-{uuid.uuid4().hex}"
    _remember(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    It cuts lineage: what follows reads files that survive any executor, so
    values that depend on how rows were dealt (row numbers) stay as they are.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _without_leftovers(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame, share: int = 8) -> DataFrame:
    """A reliable checkpoint, for slim tables only; :func:`release` deletes it too.

    It has as many files as a ``share``-th of the shuffle partitions, as slim rows would make many small ones.
    """
    spark = df.sparkSession
    shared_root(spark)
    with _without_leftovers(spark):
        out = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // share)).checkpoint(eager=True)
    at = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if at.isDefined():
        _remember(at.get())
    return out


@contextmanager
def _without_leftovers(spark: SparkSession):
    """Queries that are made and run inside delete their shuffle files when they end: what they give is in the shared folder."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession, tag: str = "llm") -> None:
    """Delete the tables staged under ``tag``; their readers must be done."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    with _lock:
        paths = _staged.pop(tag, [])
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed until no column of ``df`` has it, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
