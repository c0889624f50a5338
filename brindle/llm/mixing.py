"""Mixing sources to target weights by entropy balancing.

Rates w of documents are sought that are as near to 1 as can be in relative entropy while each source's words add up to its
target. The dual is convex and has one multiplier a source; its solution is an exponential tilt of the document's feature, its
size against the source's mean:

    w = min(cap, exp(lambda_source * size / mean_source)),   sum(size * w) = target_source

Newton steps, kept inside a bracket that halves where a step would leave it, solve all sources at once, each on its own row: the
sizes of a source enter as classes (64 to an octave, exact below 64), counted by one distributed aggregation. So a rate is tilted by
the mean size of the document's class, which is within 1.1 % of its own size: the rate within a factor exp(0.011 |lambda| x) of its own
tilt, and the source's words, which the classes' sums make up, at the target all the same. Rates become copies from the largest class to the smallest: each class takes the whole number of copies more, or
less, that meets its share and hands what is over or under to the next, smaller one. Within a class the copies are spread evenly over the
documents by rank, from counts of hash buckets and row numbers inside them, so no source is ever sorted in one task.

Cases: a null source is a source, last in the order; a null text has no words and one copy at a rate of 1; a source without
words has target 0; very long texts are counted whole; an empty table gives an empty result; repeated rows are rows of their own. Reruns agree: ranks depend on
ids and sizes alone, and rows equal in these are interchangeable. `mix` gives its own columns alone; `repeat_rows` keeps a row's
columns, of any name, as they are. The targets are made from one row a source, in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.session import cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
STEPS = 60
PER_OCTAVE = 64
BUCKETS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def size_class(size: Column) -> Column:
    """Exact below 64, then 64 classes to an octave."""
    return F.when(size < PER_OCTAVE, size).otherwise(F.floor(F.log2(size) * PER_OCTAVE) - int(math.log2(PER_OCTAVE)) * PER_OCTAVE + PER_OCTAVE).cast("int")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> with target: weights repeat over the sources' order; what a capped one leaves is reshared.

    Filling up by weight: with sources sorted by cap * size / weight, those up to some place are full and the rest get the
    same multiple of their weights. One row for each source; the window runs over sources, not documents.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    t = totals.withColumn("_w", w).withColumn("_full", (F.col("source_size") * cap).cast("double"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("_full") / F.col("_w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumns({"_pool": F.sum("source_size").over(whole) * share, "_used": F.coalesce(F.sum("_full").over(before), F.lit(0.0)), "_rest": F.sum("_w").over(after)})
    # The level if this source and all after it are not full: right for the first that stays under its cap.
    t = t.withColumn("_level", (F.col("_pool") - F.col("_used")) / F.col("_rest"))
    t = t.withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_full"), F.struct((F.col("_full") / F.col("_w")).alias("_k"), F.col("_level")))).over(whole))
    level = F.col("_first._level")
    return t.withColumn("target", F.least(F.col("_full"), F.coalesce(level * F.col("_w"), F.col("_full")))).drop("_w", "_full", "_pool", "_used", "_rest", "_level", "_first")


def _tilt(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(hist: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, target, mean, h array<struct<c, n, m>>) -> with lam: the dual's root by guarded Newton steps, a source a row.

    m: words of the class. At a target of cap times the source's words every rate is the cap (lam null, see `rates`).
    """
    x = lambda e: (e["m"] / e["n"]) / F.col("mean")
    zero = F.lit(0.0)

    def step(s: Column, _: Column) -> Column:
        lam = s["lam"]
        both = F.aggregate(
            F.col("h"),
            F.struct(zero.alias("g"), zero.alias("d")),
            lambda a, e: F.struct(
                (a["g"] + e["m"] * _tilt(lam, x(e), cap)).alias("g"),
                (a["d"] + F.when(lam * x(e) < math.log(cap), e["m"] * x(e) * F.exp(F.least(lam * x(e), F.lit(50.0)))).otherwise(zero)).alias("d"),
            ),
            lambda a: F.struct((a["g"] - F.col("target")).alias("g"), a["d"].alias("d")),
        )
        return F.transform(
            F.array(both),
            lambda b: F.struct(
                F.when(b["g"] < 0, lam).otherwise(s["lo"]).alias("lo"),
                F.when(b["g"] < 0, s["hi"]).otherwise(lam).alias("hi"),
                F.when(b["d"] > 0, lam - b["g"] / b["d"]).alias("next"),
            ),
        )[0]

    def guarded(s: Column, i: Column) -> Column:
        return F.transform(
            F.array(step(s, i)),
            lambda n: F.struct(
                n["lo"].alias("lo"),
                n["hi"].alias("hi"),
                F.when((n["next"] > n["lo"]) & (n["next"] < n["hi"]), n["next"]).otherwise((n["lo"] + n["hi"]) / 2).alias("lam"),
            ),
        )[0]

    # The smallest feature of a class with words is 1 / mean: at log(cap) * mean every rate has reached the cap.
    hi = F.greatest(F.col("mean"), F.lit(1.0)) * math.log(cap) * 1.01
    start = F.struct((-hi * 50).alias("lo"), hi.alias("hi"), zero.alias("lam"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, guarded, lambda s: s["lam"])
    return hist.withColumn("lam", F.when(F.col("target") < F.col("source_size") * cap, root))


def rates(size_mean: Column, mean: Column, lam: Column, cap: int = CAP) -> Column:
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(_tilt(lam, size_mean / mean, cap))


def _plan(solved: DataFrame, cap: int) -> DataFrame:
    """(source, c, n, base, extra): each class's copies for all and its number of copies more or less, the carry going down the sizes."""
    down = F.sort_array(F.col("h"), asc=False)

    def one(s: Column, e: Column) -> Column:
        mean = e["m"] / e["n"]
        rate = rates(mean, F.col("mean"), F.col("lam"), cap)
        base = F.least(F.floor(rate), F.lit(cap)).cast("int")
        want = e["m"] * rate + s["carry"] - base * e["m"]
        room = e["n"] * (F.lit(cap).cast("long") - base)
        extra = F.when(mean > 0, F.greatest(-base * e["n"], F.least(room, F.round(want / mean).cast("long")))).otherwise(F.lit(0).cast("long"))
        done = F.struct(e["c"].alias("c"), e["n"].alias("n"), base.alias("base"), extra.cast("long").alias("extra"))
        return F.struct((want - extra * mean).alias("carry"), F.concat(s["plan"], F.array(done)).alias("plan"))

    none = F.from_json(F.lit("[]"), "array<struct<c:int,n:bigint,base:int,extra:bigint>>")
    plan = F.aggregate(down, F.struct(F.lit(0.0).alias("carry"), none.alias("plan")), one, lambda s: s["plan"])
    return solved.withColumn("_plan", plan).select("source", "source_size", "target", F.explode("_plan").alias("p")).select("source", "source_size", "target", "p.*")


def source_key(source: Column) -> Column:
    """Never null, and in the sources' order: by code point, null last. So equal keys can share a partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, whole_rows: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of each row; with whole_rows, its columns as _row."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if whole_rows else []
    rows = docs.select(F.col(doc_id).alias("_id"), source_key(F.col(source)).alias("_source"), word_count(F.col(text)).alias("size"), *row)
    rows = rows.withColumn("_c", size_class(F.col("size"))).withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(BUCKETS)).cast("int"))
    rows = rows if whole_rows else cut(rows)
    cells = cut(rows.groupBy("_source", "_c", "_b").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("m")))
    classes = cells.groupBy("_source", "_c").agg(F.sum("n").alias("n"), F.sum("m").cast("double").alias("m"))
    hist = classes.groupBy(F.col("_source").alias("source")).agg(
        F.sum("m").cast("long").alias("source_size"), F.sum("n").alias("_docs"), F.collect_list(F.struct(F.col("_c").alias("c"), "n", "m")).alias("h")
    )
    goal = targets(hist.select("source", "source_size"), weights, share, cap).select("source", "target")
    hist = hist.join(goal, "source").withColumn("mean", F.greatest(F.col("source_size") / F.col("_docs"), F.lit(1e-9)))
    # Cut in between, as the plan's lambdas would otherwise each solve the dual anew.
    plan = cut(_plan(cut(solve(hist, cap)), cap)).withColumnsRenamed({"source": "_source", "c": "_c"})
    within = Window.partitionBy("_source", "_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("_source", "_c", "_b", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_first"))
    cell = first.join(plan, ["_source", "_c"])
    key = ["_source", "_c", "_b"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("size", F.xxhash64("_id"), "_id"))
    out = rows.withColumn("_r", rank).join(cell, key)  # in the partitioning of the ranks
    place = F.col("_first") + F.col("_r")
    even = lambda k: F.floor(k * F.col("extra") / F.col("n"))
    copies = (F.col("base") + even(place) - even(place - 1)).cast("long")
    return out.select(F.col("_id").alias(doc_id), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["_row"] if row else []))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it; the columns stay as they are."""
    out = mix(docs, whole_rows=True, **options)
    rows = out.select(F.explode(F.sequence(F.lit(1), F.when(F.col("copies") > 0, F.col("copies")).cast("int"))), "_row")
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
