"""Usage, gauges, rates, routing and cost over event and model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usage_summary(events: DataFrame, by: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events, quantity (0 where none) and cost (null where none) by a key in a half-open window (A4)."""
    if start is not None:
        events = events.where(F.col("ts") >= start)
    if end is not None:
        events = events.where(F.col("ts") < end)
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"), F.sum("cost").alias("cost"))


def status_counts(df: DataFrame, by: list[str], status: str, values: list[str]) -> DataFrame:
    """Rows by status and in all."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values], F.count(F.lit(1)).alias("total"))


def batch_state(counts: DataFrame) -> DataFrame:
    """A batch is done when nothing is in progress; failed if all failed, else completed."""
    done = F.when(F.col("n_in_progress") > 0, "in_progress").when(F.col("n_failed") == F.col("total"), "failed").otherwise("completed")
    return counts.withColumn("status", done)


def rate_breaches(events: DataFrame, subject: str, bucket: str, limit: int, ts: str = "ts") -> DataFrame:
    """Subject, bucket and minute with more events than the limit (A12, ST2)."""
    counts = events.groupBy(subject, bucket, F.date_trunc("minute", ts).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit)


def gauges(events: DataFrame, orders: DataFrame, places: int = 4) -> DataFrame:
    """One row of gauges from one pass over each table (A8). Times are whole seconds, the nearest ones, of two as near the even one."""
    epoch = lambda ts: F.rint(F.unix_micros(ts.cast("timestamp")) / 1e6).cast("long")
    e = events.agg(
        F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"),
        epoch(F.max("ts")).alias("last_event_epoch"), F.round(F.sum("value"), places).alias("value"),
    )
    o = orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), epoch(F.min(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")))).alias("oldest_open_epoch"))
    return e.crossJoin(o)  # one row and one row


def document_bytes(chunks: DataFrame, doc: str, text: str) -> DataFrame:
    return chunks.groupBy(doc).agg(F.sum(F.octet_length(text)).alias("bytes"))


def inventory(df: DataFrame, strata: list[str], size: str, digest: str, large: int) -> DataFrame:
    """Counts, bytes, largest, number over a size and repeated digests by strata."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata, digest))
    return df.withColumn("_n", n).groupBy(*strata).agg(
        F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.count_if(F.col(size) > large).alias("over"), F.count_if(F.col("_n") > 1).alias("repeated"),
    )


def year_band(year: Column, width: int = 5) -> Column:
    return (F.floor(year / width) * width).cast("int")


def embedding_cost(tokens: Column, price_per_million: Column, known: Column) -> tuple[Column, Column]:
    """Cost at ten places, and why there is none."""
    cost = F.when(price_per_million.isNotNull(), F.round(tokens / 1e6 * price_per_million, 10))
    return cost, F.when(~known, "unknown_model_profile").when(price_per_million.isNull(), "cost_unavailable")


CODE = (".py", ".ts", ".tsx", ".js", ".java", ".go", ".rs", ".cs", ".php")
TABLES, LOGS = (".csv", ".tsv", ".json", ".jsonl"), (".log", ".logs", ".err", ".out", ".stacktrace")


def select_mode(filename: Column, mime: Column, requested: Column, from_pdf: Column) -> Column:
    """The ingestion mode of a file (R1): as asked for, else by name and type."""
    name, mime = F.lower(F.coalesce(filename, F.lit(""))), F.lower(F.coalesce(mime, F.lit("")))
    ends = lambda parts: name.rlike("(" + "|".join(p.replace(".", r"\.") for p in parts) + ")$")
    return (
        F.when(requested.isNotNull() & (requested != "") & (requested != "auto_detect_v1"), requested)
        .when(ends([".md"]) & F.coalesce(from_pdf, F.lit(False)), "pdf_markdown_external_v1")
        .when(ends([".md"]) | mime.isin("text/markdown", "text/x-markdown"), "markdown_docs_v1")
        .when(ends([".pdf"]) | (mime == "application/pdf"), "raw_pdf_research_v1")
        .when(ends(CODE), "code_repo_v1")
        .when(ends(TABLES) | mime.isin("text/csv", "text/tab-separated-values", "application/json", "application/jsonl", "application/x-ndjson"), "tables_csv_json_v1")
        .when(ends(LOGS) | mime.isin("text/x-log", "application/log", "application/x-log"), "logs_errors_v1")
        .otherwise("markdown_docs_v1")
    )


def embedding_profile(mode_profile: Column, level: Column, private: str, default: str, private_from: int = 4) -> Column:
    """The mode's profile, but a private one from a level on (R2)."""
    return F.when(level >= private_from, private).otherwise(F.coalesce(mode_profile, F.lit(default)))


def ingestion_plan(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scored candidates of each request, allowed and best first.

    requests: (request_id, mode, level); candidates: (mode, position from 0, profile, preferred, private, mock).
    """
    high = F.col("level") >= 4
    gate = ~high | F.col("private")
    score = 100 - 7.5 * F.col("position") + F.when(F.col("preferred"), 15).otherwise(0) + F.when(high & F.col("private"), 10).otherwise(0) - F.when(F.col("mock"), 30).otherwise(0) - F.when(~gate, 100).otherwise(0)
    rows = requests.join(candidates, "mode").withColumn("allowed", gate).withColumn("score", score.cast("double"))  # a configuration table
    w = Window.partitionBy("request_id").orderBy(F.col("allowed").desc(), F.col("score").desc(), "position")
    return rows.withColumn("plan_rank", F.row_number().over(w))


def endpoint_state(status: Column, health: Column, fallback: Column) -> Column:
    """Where an endpoint's traffic goes."""
    well = F.lower(health).isin("ok", "healthy", "up", "ready")
    return F.when(status != "enabled", "disabled").when(well, "active").when(fallback, "fallback").otherwise("unavailable")
