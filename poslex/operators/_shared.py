"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lets Spark delete an execution's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: list[str] = []
_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="poslex-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, name: str) -> str:
    """A folder in the shared one, made for a table; it is deleted by clean_up, and at the latest when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    for made in getattr(_open, "scopes", []):
        made.append(path)
    files, at = _file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors.

    Shuffle files of the step go with its end, as nothing will read them again.
    """
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)


@contextmanager
def only_kept(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Deletes, when it ends well, the tables that this thread wrote inside, but for those put into ``keep``."""
    made: list[str] = []
    _open.scopes = [*getattr(_open, "scopes", []), made]
    try:
        yield
        for path in made:
            if path in _paths and path not in [t._written_at for t in keep]:
                _delete(spark, path)
    finally:
        _open.scopes = [x for x in _open.scopes if x is not made]


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)
    if path in _paths:
        _paths.remove(path)


def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that this process wrote; results that weren't written elsewhere can't be read afterwards."""
    for path in list(_paths):
        _delete(spark, path)
