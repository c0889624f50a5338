"""The training-data pipeline: stages over documents, each written as Parquet and read again as the next one's input.

1.  quality classifier: documents that the rule ensemble rejects go.
2.  near-dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays.
3.  decontamination: documents that share ten words in a row, or a whole shorter item, with the benchmark go.
4.  mixing: each document is repeated by its number of copies in the mix, which may be none.
5.  sharding: each row of the mix keeps its columns and gets its shard and slot.

Stages take tables with further columns, of any name, and keep them; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, mixing, near_dup, rule_classifier, sharding
from brindle.llm.queries import N_SHARDS
from brindle.llm.session import new_folder, remove_folder, table, tables_removed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts as good, trained on the labels of these documents; empty texts are scored like any other."""
    model = rule_classifier.train(docs, table(spark, sf_dir, "labels"))
    return rule_classifier.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates; texts without words are in no group."""
    return near_dup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no word is hit by a benchmark window."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, zero to two times."""
    return mixing.repeat_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as they are, with their shard and slot."""
    return sharding.with_shards(docs, N_SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: A fitted model and a randomised search can't be said in SQL; tests hold each stage against a plain version of it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's input and the tables it made on the way are removed once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with tables_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(at := new_folder(spark))
        docs = spark.read.parquet(at)
        if before is not None:
            remove_folder(spark, before)
        before = at
    return docs
