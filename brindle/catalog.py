"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import audit_plans, harvest_plans, index_plans, registry, relational_plans, retrieval_plans, text_plans  # noqa: F401  (the plans register themselves)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["hybrid_search"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
