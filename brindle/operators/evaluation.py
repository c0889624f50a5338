"""Retrieval metrics and what is decided from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def query_metrics(ranked: DataFrame, expected: DataFrame, k: int, forbidden: DataFrame | None = None) -> DataFrame:
    """(query_id, recall, precision, rr, ndcg, leakage) of ranked (query_id, chunk_id, rank) against expected (query_id, chunk_id).

    A result counts at its first place. Queries without expected results aren't judged.
    """
    first = ranked.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    want = expected.select("query_id", "chunk_id").distinct()
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = first.join(want, ["query_id", "chunk_id"]).groupBy("query_id").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k).cast("long")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    out = size.join(hits, "query_id", "left").select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), (F.coalesce("hits", F.lit(0)) / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )
    if forbidden is None:
        return out.withColumn("leakage", F.lit(0).cast("long"))
    leaks = first.join(forbidden.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("leakage"))
    return out.join(leaks, "query_id", "left").withColumn("leakage", F.coalesce("leakage", F.lit(0)))


def mean_metrics(per_query: DataFrame, by: list[str] = ()) -> DataFrame:
    """Means at six places, leakage summed."""
    means = [F.round(F.avg(m), 6).alias(m) for m in ("recall", "precision", "rr", "ndcg")]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *means, F.sum("leakage").alias("leakage"))


def bakeoff_score(recall: Column, rr: Column, ndcg: Column, precision: Column, leakage: Column, places: int = 6) -> Column:
    """Rounded once, as the product with a power of ten: a score is no other number by the decimals it happens to be shown with."""
    score = 0.45 * recall + 0.25 * rr + 0.2 * ndcg + 0.1 * precision - F.least(leakage, F.lit(10)) / 10
    return F.round(score * 10.0**places) / 10.0**places


def select_best(results: DataFrame, metric: str, minimums: dict[str, float], name: str | None = "profile") -> DataFrame:
    """results with the reasons against each and the one chosen: the best metric among those with none (E5), of equal ones the first by
    name; without a name all that share it."""
    why = F.filter(F.array(*[F.when(F.col(m) < v, F.lit(f"{m} below {v}")) for m, v in minimums.items()]), lambda x: x.isNotNull())
    rows = results.withColumn("reasons", why)
    w = Window.partitionBy(F.size("reasons") == 0).orderBy(F.col(metric).desc(), *([name] if name else []))  # one row a candidate
    return rows.withColumn("selected", (F.size("reasons") == 0) & (F.rank().over(w) == 1))


def threshold_failures(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """min_<metric> and max_<metric> rules that a row breaks."""
    rule = lambda n, v: F.when((F.col(n[4:]) < v) if n.startswith("min_") else (F.col(n[4:]) > v), F.lit(n))
    return metrics.withColumn("failures", F.filter(F.array(*[rule(n, v) for n, v in sorted(thresholds.items())]), lambda x: x.isNotNull()))


def percentile_linear(values: Column, p: float) -> Column:
    return F.percentile(values, p)


def percentiles_by_rank(df: DataFrame, value: str, by: list[str], p: float) -> DataFrame:
    """nearest: the value at round(p * (n - 1)); floor: at int(p * n) - 1.

    Distinct values and their counts give the ranks, so a group costs a row for each value, not for each row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    rows = counts.withColumn("hi", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    lo = F.col("hi") - F.col("c")
    near = F.bround(F.lit(p) * (F.col("n") - 1)).cast("long")
    floor = F.greatest(F.lit(0), F.floor(F.col("n") * p) - 1)
    at = lambda i: F.max(F.when((i >= lo) & (i < F.col("hi")), F.col(value)))
    return rows.groupBy(*by).agg(at(near).alias("nearest"), at(floor).alias("floor"))


def file_metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query over files in the order they first appear (E6): hit, top1, rr, unique files, share of repeated files."""
    first = results.groupBy("query_id", "filename").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy("rank")
    files = first.withColumn("file_rank", F.row_number().over(w)).join(expected.withColumn("wanted", F.lit(True)), ["query_id", "filename"], "left")
    best = F.min(F.when(F.col("wanted"), F.col("file_rank")))
    return files.groupBy("query_id").agg(
        F.coalesce(best <= k, F.lit(False)).alias("hit"), F.coalesce(best == 1, F.lit(False)).alias("top1"), F.coalesce(1 / best, F.lit(0.0)).alias("rr"),
        F.count(F.lit(1)).alias("unique_files"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate"),
    )


def recall_at(results: Column, wanted: Column, k: int) -> Column:
    """Whether the wanted id is among the first k of an array."""
    return F.array_contains(F.slice(results, 1, k), wanted)


def term_support(text: Column, terms: Column) -> Column:
    """The share of the terms that the text holds as whole tokens."""
    from brindle.functions.text import contains_phrase

    return F.when(F.size(terms) == 0, F.lit(1.0)).otherwise(F.size(F.filter(terms, lambda t: contains_phrase(text, t))) / F.size(terms))


def cited_in_retrieved(cited: Column, retrieved: Column) -> Column:
    return F.size(F.array_except(cited, retrieved)) == 0


def profile_checks(text: Column, minimums: dict[str, Column], anchors: list[str]) -> Column:
    """Reasons against an extraction (X2): measures under their minimum, anchors that are missing."""
    low = [F.when(~c, F.lit(f"below minimum: {n}")) for n, c in minimums.items()]
    gone = [F.when(~F.contains(text, F.lit(a)), F.lit(f"missing: {a}")) for a in anchors]
    return F.filter(F.array(*low, *gone), lambda x: x.isNotNull())
