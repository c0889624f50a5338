"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contracts' white space; a word is a run of anything else.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; `lower` would fold other alphabets too."""
    return F.translate(c, _UPPER, _LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def remove_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


#: Folders of the tables that `cut` has written and nobody has removed yet.
_TABLES: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage by a table in the shared folder: written in one pass over df, where checkpoint() takes two, and read back.

    What reads it survives the loss of executors. The table stays until `tables_removed` ends around the call, or Python does.
    """
    spark = df.sparkSession
    df.write.parquet(at := new_table(spark))
    return spark.read.schema(df.schema).parquet(at)


def new_table(spark: SparkSession) -> str:
    """A folder for a table that grows by `append`, removed as those of `cut` are."""
    if not _TABLES:
        atexit.register(_forget, spark, 0)
    _TABLES.append(at := new_folder(spark))
    return at


def append(df: DataFrame, at: str) -> None:
    df.write.mode("append").parquet(at)


def _forget(spark: SparkSession, first: int) -> None:
    while len(_TABLES) > first:
        try:
            remove_folder(spark, _TABLES.pop())
        except Exception:  # noqa: BLE001  (at exit the session may have ended before; what is left goes with the shared folder)
            pass


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Around work whose result is stored for good: tables cut inside it are removed at its end."""
    first = len(_TABLES)
    try:
        yield
    finally:
        _forget(spark, first)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def hidden(df: DataFrame, *stems: str) -> list[str]:
    """A free column name for each stem."""
    return [free_name(df, s) for s in stems]
