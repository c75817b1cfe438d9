"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 class of a word character of the contract: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of the default 64 MB, which a task holds several times in two processes. A
    session that sets its own size keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(key, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs in one process (local tests) a temporary folder is set; on a cluster
    executors would not see it, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.isLocal:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexiflow-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more: what was made from them is written itself. Shuffle
    files of plans that ended go when the driver's JVM collects those plans, so it is asked to."""
    for f in frames:
        context = f.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f._written)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


#: Ids that every task may hold at once, so that rows with texts stay where they are.
FEW = 1 << 21


def few(ids: DataFrame) -> DataFrame:
    """A written column of ids, broadcast if there are at most ``FEW``; else a join with it sorts both sides."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def words(text: Column) -> Column:
    """Words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, without building the filtered array."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    empty_head = (F.element_at(parts, 1) == "").cast("int")
    empty_tail = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - empty_head - empty_tail).cast("long")


def trim() -> None:
    """Hand freed memory back to the system."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Seconds after which a Python worker without a task drops the tables it keeps for its next one.
IDLE_SECONDS = 1.0
_timers: dict[int, threading.Timer] = {}


@contextlib.contextmanager
def idle(held: dict):
    """Tables that a worker keeps from task to task: they stay while tasks follow one another and are dropped once the
    worker has been idle, since workers live on and serve other stages."""

    def drop() -> None:
        import gc

        held.clear()
        gc.collect()
        trim()

    waiting = _timers.pop(id(held), None)
    if waiting is not None:
        waiting.cancel()
    try:
        yield
    finally:
        timer = _timers[id(held)] = threading.Timer(IDLE_SECONDS, drop)
        timer.daemon = True
        timer.start()


def tidy(run):
    """An Arrow function that hands freed memory back to the system when it ends: Python workers live on and serve
    other stages, whose memory adds to what the allocator still holds."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            from . import _words

            _words.release()
            trim()

    return wrapped
