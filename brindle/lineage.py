"""Tables on the way: where a plan would grow with each round, or be computed by each reader, it is written once and read back."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that `new_folder` has given out and nobody has removed yet.
_FOLDERS: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A local session may have none set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="brindle"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared one; it goes when `tables_removed` ends around the call, or Python does."""
    at = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if not _FOLDERS:
        atexit.register(_forget, spark, 0)
    _FOLDERS.append(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what reads it survives the loss of executors."""
    df.write.parquet(path := new_folder(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, first: int) -> None:
    while len(_FOLDERS) > first:
        try:
            remove_folder(spark, _FOLDERS.pop())
        except Exception:  # noqa: BLE001  (at exit the session may have ended before; what is left goes with the shared folder)
            pass


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Around work whose result is stored for good: tables cut inside it are removed at its end."""
    first = len(_FOLDERS)
    try:
        yield
    finally:
        _forget(spark, first)
