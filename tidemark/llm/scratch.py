"""Tables that an operator writes to cut lineage, in the folder all executors share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import sys
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What each thread of a session has written and not deleted.
_OPEN: dict[tuple[str, int], list[str]] = {}
_TABLES: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset and all is local (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return qualified(spark, folder).rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """A path with its scheme: what Spark takes for the default file system, Python in tasks cannot know."""
    if "://" in folder:
        return folder
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub("^file:/+", "file:///", whole)


def importable(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver found it."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))
    if here not in sys.path:
        sys.path.insert(0, here)


def _here(spark: SparkSession) -> tuple[str, int]:
    return spark.sparkContext.applicationId, threading.get_ident()


def path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    importable(spark)
    new = f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _OPEN.setdefault(_here(spark), []).append(new)
    return new


def released() -> None:
    """Of this Python process: free memory goes back to the system. Python workers outlive their tasks, and the C library's heap else keeps
    the most that any of them had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def settled(spark: SparkSession) -> None:
    """In the driver, between the steps of a long job: what finished queries have left there goes. Each stage and each scan leaves a
    block of some 4 MB, which the heap else grows by; broadcasts and shuffles, too, are dropped when the driver collects its garbage."""
    spark._jvm.System.gc()
    released()


def table(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` once and return what was written: later jobs, and tasks run again after a lost executor, start here.
    ``most``: files at most, where the caller knows how much there is. Each file costs a commit, and on a local file
    system two processes that the executor starts (chmod), so small tables should not have one for each partition."""
    spark = df.sparkSession
    at = path(spark, name)
    df = df if most is None else df.coalesce(most)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def observed(df: DataFrame, name: str, most: int | None = None, **facts: Column) -> tuple[DataFrame, dict]:
    """Like :func:`table`, with aggregates of the rows (by default their number, ``rows``) that the write gathers on its way. To ask the
    written table takes a query more, and the driver holds some MB for each scan and stage until its garbage is collected. Tasks that
    run again may count twice: good for sizes, bounds and whether there are rows."""
    seen = Observation()
    df = df if most is None else df.coalesce(most)
    out = table(df.observe(seen, *[c.alias(k) for k, c in (facts or {"rows": F.count(F.lit(1))}).items()]), name)
    return out, seen.get


def written(spark: SparkSession) -> list[str]:
    """What this thread has written and not deleted so far."""
    return list(_OPEN.get(_here(spark), []))


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete tables written here (all, or ``paths``). Only for callers who have stored every result made of them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mine = _OPEN.get(_here(spark), [])
    for at in [p for p in mine if paths is None or p in paths]:
        mine.remove(at)
        if at in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(at)}")
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(conf).delete(where, True)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """Like :func:`table`, in ``n`` buckets of ``column``: joins on it read the rows where they are."""
    spark = df.sparkSession
    at = path(spark, name)
    table_name = f"tidemark_{at.rsplit('-', 1)[1]}"
    _TABLES[at] = table_name
    df.write.option("compression", "zstd").option("path", at).bucketBy(n, column).saveAsTable(table_name)
    return spark.table(table_name)
