"""Intermediate tables in the folder that driver and executors share."""

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a new local folder in local mode (one machine, as in tests), and an error on a
    cluster, whose executors could not see it."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="skiff-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


_PATHS: dict[int, tuple] = {}
#: Whether a query's shuffle files go when it is over; by default they stay until the driver collects its garbage.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_CONF, before) if before is not None else spark.conf.unset(_CLEANUP_CONF)


def stored(df: DataFrame) -> DataFrame:
    """df with its lineage cut: a Parquet table in the shared folder, so that a lost executor costs nothing that was
    computed. Shuffle files of its making are gone then. discard() removes it."""
    path = new_folder(df.sparkSession, "stored")
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes stored() tables that nothing will read again; others are left alone."""
    for df in tables:
        known, path = _PATHS.pop(id(df), (lambda: None, ""))
        if known() is df:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
