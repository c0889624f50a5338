"""Sinks: idempotent writes of partitioned tables, JSON lines, bundles with a manifest, and appended events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.hashing import uuid5


#: Rows of a file.
FILE_ROWS = 1_000_000


def vectors(df: DataFrame, path: str, partition: str = "embedding_profile_id", key: str = "chunk_id") -> None:
    """Vectors by profile under deterministic point ids; a profile's partition is replaced as a whole, in as many files as it needs (K1)."""
    out, files = df.withColumn("point_id", uuid5(F.col(key))), max(1, -(-df.count() // FILE_ROWS))
    out.repartition(partition, F.pmod(F.xxhash64(key), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def index(postings: DataFrame, path: str, buckets: int = 16) -> None:
    """Postings clustered by a hash of the term, so that a query reads few files; a bucket is as many files as its rows need (K2)."""
    files = max(1, -(-postings.count() // (buckets * FILE_ROWS)))
    spread = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    spread.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(files))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """Compact objects with sorted keys (K9)."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def bundle(tables: dict[str, DataFrame], path: str, failed: int = 0) -> DataFrame:
    """Tables as JSON lines with a manifest of counts and a status (K10), which is returned."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        json_lines(df, f"{path}/{name}")
    counts = {n: spark.read.json(f"{path}/{n}").count() if tables[n].columns else 0 for n in tables}
    status = next((f"failed_no_{n}" for n in ("pages", "sections") if n in counts and not counts[n]), "partial_with_failures" if failed else "success")
    manifest = spark.createDataFrame([(n, c, status) for n, c in counts.items()], "name string, n long, status string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def append_events(df: DataFrame, path: str) -> None:
    """Audit and usage events by day."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def state(df: DataFrame, path: str) -> None:
    """A small state table, replaced by the commit protocol as a whole."""
    df.coalesce(1).write.mode("overwrite").json(path)
