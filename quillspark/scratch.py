"""Intermediate tables, written to the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="quillspark-"))
    return f"file://{_own[0]}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """How many paths there have been so far, for ``since``."""
    return len(_written)


def since(begin: int) -> list[tuple[SparkSession, str]]:
    """The paths made since a mark."""
    return _written[begin:]


def drop(paths: list[tuple[SparkSession, str]]) -> None:
    """Removes tables that nothing reads any more."""
    for spark, path in paths:
        _delete(spark, path)


def _drop_written() -> None:
    try:
        drop(_written)
    except Exception:  # the JVM may have ended before; the folder is the cluster's to clean
        return


atexit.register(_drop_written)


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


#: Bytes of a broadcast's pieces.  Each stage and scan broadcasts some KB and takes a whole piece of the driver's heap for it; at Spark's 4 MB that is
#: a humongous object, of which most collections of the driver's garbage come and by which its heap grows.
_PIECES, PIECE = "spark.broadcast.blockSize", "256k"


@contextmanager
def small_pieces(spark: SparkSession) -> Iterator[None]:
    """What is broadcast meanwhile is cut into pieces of PIECE; who reads a broadcast knows their number, not their size."""
    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    before = conf.get(_PIECES, "")
    conf.set(_PIECES, PIECE)
    try:
        yield
    finally:
        conf.set(_PIECES, before) if before else conf.remove(_PIECES)


def give_back(spark: SparkSession) -> bool:
    """The driver's garbage goes, and what its JVM has freed goes back to the system; whether the JVM can do the latter (Linux, Java 17.0.9 or later)."""
    java = spark._jvm.java
    java.lang.System.gc()
    gateway = spark.sparkContext._gateway
    # Through the interface, as the server's own class is not open to reflection.
    kinds = gateway.new_array(java.lang.Class, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = java.lang.Class.forName(name)
    args = gateway.new_array(java.lang.Object, 4)
    args[0], args[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke = java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


#: Shuffle files go when the execution that made them ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, what: str, begin: int) -> DataFrame:
    """Like ``written``; the tables made since the mark ``begin``, of which nothing but ``df`` may be needed, go."""
    done = since(begin)
    out = written(df, what)
    drop(done)
    _written[begin:] = [x for x in since(begin) if x not in done]
    return out
