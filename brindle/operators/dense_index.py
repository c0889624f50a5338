"""An approximate index for dense search: coarse clusters as partition folders, product-quantised codes, exact re-ranking.

*   `build` fits cluster centres and a code book for each part of the vector on a bounded sample (MAX_SAMPLE rows), then assigns every
    row: its list, the nearest centre, and a byte for each part, the nearest entry of the part's book to what the centre leaves.
*   The table lies in folders by list, in as many files as its rows need; codes and vectors are columns, so a scan of codes reads no vector.
*   A query goes to its `probes` nearest lists. Only their folders are read: a score is the product with the centre plus a table look-up
    for each part. The best `depth` rows of each query are ranked again by the exact cosine.

How many probes and how great a depth a recall takes depends on the vectors: `tuned` measures both on a sample. With all lists and no `depth` the answer
is exact, as `retrieval.dense_search` gives it without an index. Null vectors aren't indexed; all are of one length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from brindle.functions import hashing as hs
from brindle.operators.retrieval import _query_blocks, _unit, near_edge, query_spans

#: Rows that the index is fitted on, at most; numbers of a vector in one part; entries of a part's book; rows of a list's file.
MAX_SAMPLE, PART, ENTRIES, FILE_ROWS = 20_000, 4, 256, 1_000_000
LISTS = 64


@dataclass
class Quantiser:
    """centres: a row a list; books: part x entry x numbers."""

    centres: np.ndarray
    books: np.ndarray

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector and its codes."""
        own = _nearest(unit, self.centres)
        rest = _padded(unit - self.centres[own], self.books)
        codes = [_nearest(rest[:, i], book) for i, book in enumerate(self.books)]
        return own.astype(np.int32), np.stack(codes, 1).astype(np.uint8)

    def probes(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The n lists whose centres have the largest product with each query, best first."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """query x part x entry: the product of the query's part with each entry."""
        return np.einsum("qpn,pen->qpe", _padded(unit, self.books), self.books)


def _padded(rows: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, n = books.shape
    return np.pad(rows, ((0, 0), (0, parts * n - rows.shape[1]))).reshape(len(rows), parts, n)


def _nearest(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((to**2).sum(1) - 2 * rows @ to.T).argmin(1)


def _means(rows: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    """k-means from different rows; a centre that loses all rows goes to the row farthest from its own."""
    rows_of = np.unique(rows, axis=0)
    r = np.random.default_rng(seed)
    centres = rows_of[r.permutation(len(rows_of))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(rows, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            far = np.argsort(-((rows - centres[own]) ** 2).sum(1))[: len(lost)]
            centres[lost[: len(far)]] = rows[far]
    return centres


def fit(sample: np.ndarray, lists: int = LISTS, rounds: int = 12) -> Quantiser:
    unit = _unit(sample.astype(np.float64))
    centres = _means(unit, lists, rounds)
    rest = unit - centres[_nearest(unit, centres)]
    parts = -(-unit.shape[1] // PART)
    rest = np.pad(rest, ((0, 0), (0, parts * PART - unit.shape[1]))).reshape(len(unit), parts, PART)
    books = [_means(rest[:, i], ENTRIES, rounds) for i in range(parts)]
    most = max(len(b) for b in books)
    return Quantiser(centres, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]))


def build(vectors: DataFrame, path: str, keep: list[str] = (), chunk_id: str = "chunk_id", vector: str = "embedding", lists: int = LISTS) -> Quantiser:
    """Fits the index and writes every row to it: the id, the columns `keep`, the list, the codes and the vector."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), *keep, F.col(vector).cast("array<double>").alias("embedding"))
    sample = [r.embedding for r in rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(MAX_SAMPLE).select("embedding").collect()]
    q = fit(np.array(sample, np.float64), lists) if sample else Quantiser(np.zeros((1, 1)), np.zeros((1, 1, PART)))
    kinds = [("centre", i, 0, c.tolist()) for i, c in enumerate(q.centres)] + [("entry", p, e, v.tolist()) for p, b in enumerate(q.books) for e, v in enumerate(b)]
    spark.createDataFrame(kinds, "kind string, i int, j int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantiser")
    add(rows, path, keep, "overwrite", q)
    return q


def open_quantiser(spark: SparkSession, path: str) -> Quantiser:
    rows = sorted(map(tuple, spark.read.parquet(f"{path}/quantiser").collect()))
    centres = np.array([v for kind, _, _, v in rows if kind == "centre"])
    entries = [(i, v) for kind, i, _, v in rows if kind == "entry"]
    return Quantiser(centres, np.array([v for _, v in entries]).reshape(entries[-1][0] + 1, -1, len(entries[0][1])))


def add(rows: DataFrame, path: str, keep: list[str] = (), mode: str = "append", quantiser: Quantiser | None = None) -> None:
    """Writes further rows (chunk_id, keep, embedding) under the index's lists; the quantiser stays as it is.

    A list's rows are dealt to as many files as they need, so that no list, however large, is one task.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(quantiser or open_quantiser(spark, path))
    own = rows.select("chunk_id", *keep, "embedding")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = b.column(b.num_columns - 1)
                unit = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                where, codes = sent.value.assign(unit)
                yield b.append_column("codes", pa.array([c.tobytes() for c in codes], pa.binary())).append_column("list", pa.array(where))

    files = max(1, -(-rows.count() // FILE_ROWS))  # of a list that has all rows
    dealt = own.mapInArrow(run, f"{schema}, codes binary, list int").repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(files)))
    dealt.write.mode(mode).partitionBy("list").parquet(f"{path}/lists")


def search(
    spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int, depth: int | None = None, allowed: DataFrame | None = None, places: int | None = None,
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k nearest of each query (query_id, embedding) among its probed lists.

    depth: rows of a query that the codes choose for the exact ranking; None ranks all rows of the lists exactly. allowed: rows with
    columns of the index (a scope) that a hit must agree with, applied before any cut. places: exact scores are rounded to so many
    before they are ranked.
    """
    q = open_quantiser(spark, path)
    table = spark.read.parquet(f"{path}/lists")
    if allowed is not None:
        table = table.join(allowed, [c for c in allowed.columns], "left_semi")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {table.schema['chunk_id'].dataType.simpleString()}, list int, score double"
    found = []
    for ids, unit in _query_blocks(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), "embedding"):
        near = q.probes(unit, probes)
        own = table.where(F.col("list").isin(*(int(i) for i in np.unique(near)))).select("list", "chunk_id", "codes" if depth else "embedding")
        found.append(own.mapInArrow(_scorer(spark, q, pa.array(ids, to_arrow_type(queries.schema["query_id"].dataType)), unit, near, depth or k, depth is None, places), kinds))
    if not found:
        return spark.createDataFrame([], f"{kinds}, rank int").drop("list")
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    if depth:
        hits = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= depth).select("query_id", "list", "chunk_id")
        vectors = table.select("list", "chunk_id", F.col("embedding").alias("v"))
        exact = hits.join(vectors, ["list", "chunk_id"]).join(queries.select("query_id", F.col("embedding").cast("array<double>").alias("q")), "query_id")
        score = hs.cosine(F.col("q"), F.col("v"))
        hits = exact.select("query_id", "chunk_id", (score if places is None else F.round(score, places)).alias("score"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def _scorer(spark: SparkSession, q: Quantiser, ids: pa.Array, unit: np.ndarray, near: np.ndarray, n: int, exact: bool, places: int | None):
    """Scores of the rows of each list under the queries that probe it, the first n of each batch."""
    asked = {int(i): np.flatnonzero((near == i).any(1)) for i in np.unique(near)}
    sent = spark.sparkContext.broadcast((ids, unit, None if exact else q, unit @ q.centres.T, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unit, quantiser, centre, asked = sent.value
        for b in batches:
            lists = b.column(0).to_numpy()
            for i in np.unique(lists):
                at, wanted = np.flatnonzero(lists == i), asked.get(int(i))
                if wanted is None:
                    continue
                rows = b.column(2).take(pa.array(at))
                if exact:
                    vectors = _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                else:
                    codes = np.frombuffer(b"".join(rows.to_pylist()), np.uint8).reshape(len(at), -1)
                    table_size = quantiser.books.shape[0] * quantiser.books.shape[1]  # of a query
                for first, end in query_spans(len(wanted), len(at) if exact else max(len(at), table_size)):
                    who = wanted[first:end]
                    if exact:
                        s = unit[who] @ vectors.T
                    else:
                        tables, s = quantiser.tables(unit[who]), np.repeat(centre[who, i][:, None], len(at), axis=1)
                        for p in range(codes.shape[1]):
                            s += tables[:, p][:, codes[:, p]]
                    x, y, score = near_edge(s, n, places if exact else None)
                    names = b.column(1).take(pa.array(at[y]))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(who[x])), names, pa.array(np.full(len(x), i, np.int32)), pa.array(score)], ["query_id", "chunk_id", "list", "score"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, wanted, found, recall): how many of the exact hits are among those found."""
    both = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("_f")), ["query_id", "chunk_id"], "left")
    out = both.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), F.count("_f").alias("found"))
    return out.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))


def tuned(spark: SparkSession, path: str, k: int = 10, target: float = 0.97, n_queries: int = 200) -> tuple[int, int]:
    """(probes, depth): the fewest that each reach the target share of the k nearest neighbours, measured with sampled rows as queries.

    The sample is at most MAX_SAMPLE rows; of a larger index as many more rows come before a neighbour, so the depth grows with it.
    """
    q = open_quantiser(spark, path)
    table = spark.read.parquet(f"{path}/lists")
    rows = table.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(MAX_SAMPLE).select("list", "codes", "embedding").collect()
    if not rows:
        return 1, k
    unit, own = _unit(np.array([r.embedding for r in rows])), np.array([r["list"] for r in rows])
    codes = np.frombuffer(b"".join(r.codes for r in rows), np.uint8).reshape(len(rows), -1)
    needed, deep = [], []
    for at in range(0, min(n_queries, len(unit)), 50):
        asked = unit[at : at + 50]
        best = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, : k + 1]  # a row finds itself first
        place = np.argsort(q.probes(asked, len(q.centres)), axis=1)  # of each list among a query's probes
        needed.append(np.take_along_axis(place, own[best], 1).ravel() + 1)
        tables = q.tables(asked)
        s = (asked @ q.centres.T)[:, own] + sum(tables[:, p][:, codes[:, p]] for p in range(codes.shape[1]))
        deep.append((s[:, :, None] >= np.take_along_axis(s, best, 1)[:, None, :]).sum(1).ravel())
    reach = lambda parts: int(np.quantile(np.concatenate(parts), target, method="inverted_cdf"))
    return reach(needed), -(-reach(deep) * table.count() // len(rows))
