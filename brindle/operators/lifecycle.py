"""Duplicates, versions, desired state, expiry: what happens to a collection over time, as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exact_duplicates(docs: DataFrame, scope: list[str], content: str, order: str) -> DataFrame:
    """(id, original): rows whose content another row of the scope had before (L1). Counted by digest, not by window."""
    d = docs.withColumn("_h", F.sha2(F.col(content).cast("binary"), 256))
    first = d.groupBy(*scope, "_h").agg(F.min(order).alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return d.join(first, [*scope, "_h"]).where(F.col(order) != F.col("original")).select(*scope, order, "original", "copies")


def fully_indexed(docs: DataFrame, chunks: DataFrame, key: str, indexed: Column) -> DataFrame:
    """Documents with a chunk and no chunk that isn't indexed."""
    return docs.join(chunks.select(key), key, "left_semi").join(chunks.where(~indexed).select(key), key, "left_anti")


def versions(rows: DataFrame, key: list[str], order: list[str], row_id: str) -> DataFrame:
    """version_number, is_current and superseded_by of rows of one identity (L2, A3)."""
    w = Window.partitionBy(*key).orderBy(*order)
    nxt = F.lead(row_id).over(w)
    return rows.withColumn("version_number", F.row_number().over(w)).withColumn("superseded_by", nxt).withColumn("is_current", F.col("superseded_by").isNull())


def version_target(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Which known document an incoming one replaces: by identity, else uri, else filename (L2)."""
    keys = ("source_identity", "source_uri", "filename")
    out = incoming
    for i, k in enumerate(keys):
        one = known.where(F.col(k).isNotNull()).groupBy(k).agg(F.max("document_id").alias(f"_t{i}"))
        out = out.join(one, k, "left")
    return out.withColumn("target_id", F.coalesce(*[F.col(f"_t{i}") for i in range(len(keys))])).drop(*[f"_t{i}" for i in range(len(keys))])


def reconcile(desired: DataFrame, actual: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): remove, upsert or noop, removals first."""
    d, a = desired.select(key, F.col(digest).alias("_d"), F.lit(True).alias("_want")), actual.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_have"))
    action = F.when(F.col("_want").isNull(), "remove").when(F.col("_have").isNull() | ~F.col("_d").eqNullSafe(F.col("_a")), "upsert").otherwise("noop")
    return d.join(a, key, "full").select(key, action.alias("action"), F.when(action == "remove", 0).when(action == "upsert", 1).otherwise(2).alias("step"))


def latest(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Union of which the last row of a key stays (K4): a merge without a table format."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def increment(old: DataFrame, events: DataFrame, key: list[str], count: str = "count") -> DataFrame:
    """Counters with one more for each event (K5)."""
    return old.select(*key, count).unionByName(events.select(*key, F.lit(1).cast("long").alias(count))).groupBy(*key).agg(F.sum(count).alias(count))


def resume(old: DataFrame, new: DataFrame, key: str, scope: list[str], changes: list[str]) -> DataFrame:
    """Old rows take the changes of new ones of their key whose whole scope agrees, nulls included (K6)."""
    n = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_s_{c}") for c in scope], *[F.col(c).alias(f"_n_{c}") for c in changes])
    on = old[key] == n["_k"]
    for c in scope:
        on &= old[c].eqNullSafe(n[f"_s_{c}"])
    out = old.join(n, on, "left")
    return out.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in changes}).select(*old.columns)


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def deactivate(df: DataFrame, condition: Column, status: str = "delete_queued") -> DataFrame:
    """Rows that fit lose their activity and get a status (K8)."""
    return df.withColumn("active", F.col("active") & ~condition).withColumn("status", F.when(condition, status).otherwise(F.col("status")))


def expires_at(last_active: Column, anchor: Column, days: Column) -> Column:
    """The end of a policy anchored at the last activity with a positive whole number of days; else null."""
    ok = (anchor == "last_active_at") & days.cast("string").rlike("^[1-9][0-9]{0,4}$")
    return F.when(ok, last_active + F.make_interval(days=F.when(ok, days.cast("int")).otherwise(0)))


def expired(stores: DataFrame, now: Column) -> DataFrame:
    return stores.where(F.col("expires_at") <= now)


def stale_vectors(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors whose chunk is gone or inactive (L4)."""
    return vectors.join(chunks.where("active").select(key), key, "left_anti")


def harvest_conflicts(rows: DataFrame, group: str, must_agree: list[str]) -> DataFrame:
    """Groups of repeated entries that disagree in a field."""
    counts = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))).alias(c) for c in must_agree]
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("entries"), *counts).where(" or ".join(f"`{c}` > 1" for c in must_agree))


def audit_rows(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with failures: the names of the checks that don't hold."""
    return rows.withColumn("failures", F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull()))


def unbound_fields(artifacts: DataFrame, revisions: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, unbound): artifacts whose declared fields don't all hold in their revision (X8), with the names of those that don't.

    A declared field must be there and equal; one that an artifact leaves null is not declared. Without a revision every declared field is
    unbound.
    """
    known = revisions.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_is"))
    rows = artifacts.select(key, *fields).join(known, key, "left")
    off = [F.when(F.col(f).isNotNull() & ~F.coalesce(F.col(f) == F.col(f"_r_{f}"), F.lit(False)), F.lit(f)) for f in fields]
    rows = rows.withColumn("unbound", F.array_compact(F.array(*off)))
    return rows.where(F.size("unbound") > 0).select(key, "unbound")


def classify_record(present: list[Column]) -> Column:
    """All tags there: the first branch; none: the second; some: an error."""
    n = sum((p.cast("int") for p in present[1:]), present[0].cast("int"))
    return F.when(n == len(present), "tagged").when(n == 0, "plain").otherwise("invalid")


def url_gaps(expected: DataFrame, fetched: DataFrame, key: str = "url") -> DataFrame:
    """Urls that only one side has."""
    e, f = expected.select(key).distinct(), fetched.select(key).distinct()
    return e.join(f, key, "left_anti").withColumn("gap", F.lit("not_fetched")).unionByName(f.join(e, key, "left_anti").withColumn("gap", F.lit("unexpected")))


def quality_gate(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: passed, and the reasons against it."""
    reasons = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return counts.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def merge_batches(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """The first row of each key over batches, and whether later ones had other content."""
    w = Window.partitionBy(key)
    first = F.row_number().over(w.orderBy(order))
    lo, hi = (f(F.sha2(F.coalesce(F.col(content), F.lit("")), 256)).over(w) for f in (F.min, F.max))
    return rows.withColumn("_n", first).withColumn("conflict", lo != hi).where("_n = 1").drop("_n")


def newest_revisions(stored: DataFrame, incoming: DataFrame, key: str, revision: str) -> DataFrame:
    """Stored and incoming entities of which the highest revision stays; an older one never replaces a newer."""
    w = Window.partitionBy(key).orderBy(F.col(revision).desc(), "_new")
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")
