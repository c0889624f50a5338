"""What an ingest takes is found by keys; a text moves once, and postings are not shuffled at all."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import ingest as ig

FIELDS = "document_id long, text string, version int, tenant_id string, instance_id string, active boolean, level int, groups array<string>, roles array<string>"


def rows(*of):
    return [(i, text, version, "t", "i", True, level, None, None) for i, text, version, level in of]


def test_equal_rows_null_versions_and_copies(spark):
    docs = spark.createDataFrame(rows((1, "a", 1, 1), (1, "b", 2, 1), (1, "b", 2, 1), (2, "b", 1, 1), (3, None, None, 1), (3, None, None, 1), (4, "", 1, 1), (5, "c", None, 1), (5, "d", 0, 2)), FIELDS)
    assert sorted((r.document_id, r.text, r.version, r.level) for r in ig.current(docs).collect()) == [(1, "b", 2, 1), (3, None, None, 1), (5, "d", 0, 2)]
    assert "text" not in ig.current_keys(docs).columns


def test_texts_move_once(spark, tmp_path):
    spark.createDataFrame(rows(*((i, f"text {i}", 1, 1) for i in range(50))), FIELDS).write.parquet(at := str(tmp_path / "d"))
    docs = spark.read.parquet(at)
    plan = ig.current(docs).select(F.length("text"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line or "text#" in line and "first(text" in line]
    assert windows and not any("text#" in line for line in windows if "Window [" in line)
    ig.ingest(docs, store := str(tmp_path / "s"))
    made = spark.read.parquet(f"{store}/postings")
    assert made.agg(F.sum("n")).first()[0] == 100 and made.where("size(chunks) <> n").isEmpty()
