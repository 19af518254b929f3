"""Session-level helpers: shared folders, checkpoints, tables, worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session (a
    test) that names none gets a temporary folder; on a cluster an unset
    folder is an error, as machine-local files are lost with the machine.
    """
    known = getattr(spark, "_stratakb_shared", None)
    if known:
        return known
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="stratakb-")
    spark._stratakb_shared = path
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no one else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Once a query's rows are written, its shuffle files are of no more use.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet; its shuffle files go with the write, so that disk doesn't fill with those of earlier steps."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage; a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratakb_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what materialize wrote, once all that reads it is written too."""
    for df in written:
        drop_path(df.sparkSession, df._stratakb_path)


def release(spark: SparkSession) -> None:
    """Let go of plans, broadcasts and generated classes that nothing refers to any more, on the driver.

    An iteration leaves some of each behind with every round, and the driver's
    process otherwise keeps all the memory it has once had.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _worker_store() -> dict:
    """In a module of its own, because functions pickled by value get fresh globals with every task."""
    return sys.modules.setdefault("_stratakb_worker_cache", types.ModuleType("_stratakb_worker_cache")).__dict__.setdefault("kept", {})


def worker_cache(key, build):
    """build() once per Python worker process for each key (kind, name); only the latest of all is kept."""
    store = _worker_store()
    kind, name = key
    if store.get(kind, (None,))[0] != name:
        worker_clear()  # before the next is built
        store[kind] = (name, build())
    return store[kind][1]


def worker_clear() -> None:
    """Let go of what worker_cache keeps in this Python worker process, and of its memory.

    Spark uses a worker again for the next step, or leaves it idle: a tokenizer
    of an earlier step would otherwise take an executor's memory all through
    steps that don't need it.
    """
    store = _worker_store()
    if store:
        store.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
