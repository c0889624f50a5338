"""From documents to a searchable store and back: segments that are written once, and manifests that name them.

A store is a folder of tables with a part for each segment: `documents` (scope, rights, counts), `chunks`, `vectors` by embedding profile
and `postings` in blocks. An ingest writes one segment with the documents that are new or changed, the keys of those that they replace,
and then a manifest, the list of segments and of what is gone in them; a search reads what one manifest names. So readers of an older
manifest aren't disturbed, an ingest that fails leaves nothing that anybody reads, and unchanged documents cost no writing. `compact`
makes one segment of all; `vacuum` removes what only old manifests name.

A document is (tenant, instance, store, document id). Of its versions the highest counts, ties by content hash; an older version never
replaces a newer one. Within a tenant, instance and store equal contents are one document, the one that is stored already, else that of
the smallest id. Every committed document is fully indexed, as the manifest comes last.

Rows of vectors and postings carry `acl`, a hash of scope and rights, so that a search takes only what its caller may read before any top
k, and counts nothing else: no score tells of hidden documents. Rights are asked again of the chunks that are shown.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import hashing as hs
from brindle.functions import text as tx
from brindle.lineage import cut, remove_folder
from brindle.operators import chunking as ck
from brindle.operators import lexical_index as lx
from brindle.operators import retrieval as rt
from brindle.operators.security import Principal, acl_allowed, scoped

SCOPE = ("tenant_id", "instance_id", "active", "level", "groups", "roles")
KEY = ("tenant_id", "instance_id", "store_id", "document_id")
#: Rights and query terms that a search names as literals, fused rows whose chunks are read by id, rows of a file of vectors.
FEW_ACLS, FEW_TERMS, FEW_ROWS, FILE_ROWS = 1000, 1000, 4000, 200_000
Embed = Callable[[Column, str, int], Column]


def _hash_vectors(text: Column, profile: str, dimensions: int) -> Column:
    return hs.hash_embedding(text, dimensions)


class Conflict(RuntimeError):
    """Another writer committed meanwhile."""


@dataclass(frozen=True)
class Store:
    """A store as one manifest names it."""

    spark: SparkSession
    path: str
    version: int
    segments: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()
    profiles: tuple[tuple[str, int], ...] = ()
    commit: str = ""

    @lru_cache(maxsize=64)  # a manifest never changes, and commits differ
    def table(self, name: str) -> DataFrame | None:
        """The table's parts of this manifest's segments, with their segment; None without a segment."""
        if not self.segments:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s}" for s in self.segments])

    @lru_cache(maxsize=64)
    def removed(self, name: str) -> DataFrame | None:
        """documents, chunks or terms that are gone though their segments are read."""
        if not self.gone:
            return None
        return self.spark.read.parquet(*[f"{self.path}/gone/{g}/{name}" for g in self.gone])

    @lru_cache(maxsize=64)
    def live(self, name: str) -> DataFrame | None:
        """documents or chunks without those that are gone."""
        rows, gone = self.table(name), self.removed("documents")
        if rows is None or gone is None:
            return rows
        return rows.join(gone.select("segment", "document_key"), ["segment", "document_key"], "left_anti")


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifests(spark: SparkSession, path: str) -> list[int]:
    """The versions of a store's manifests that are whole, oldest first."""
    fs, at = _fs(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[1])]
    return sorted(done)


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """The store as of its last manifest, or of an earlier one. Without any it is empty."""
    known = manifests(spark, path)
    if not known:
        return Store(spark, path, 0)
    version = known[-1] if version is None else version
    fs, at = _fs(spark, f"{path}/manifest/v{version}")
    part = next(s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    stream = fs.open(part)
    try:
        r = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Store(spark, path, version, tuple(r["segments"]), tuple(r["gone"]), tuple((p["name"], p["dimensions"]) for p in r["profiles"]), r["commit"])


def _commit(old: Store, segments: tuple, gone: tuple, profiles: tuple) -> Store:
    """Writes the next manifest; a second writer of the same number is refused and nothing of its work is ever read."""
    spark, version, own = old.spark, old.version + 1, uuid.uuid4().hex
    if manifests(spark, old.path)[-1:] > [old.version]:
        raise Conflict(f"{old.path} has a manifest after {old.version}")
    at = f"{old.path}/manifest/v{version}"
    row = json.dumps({"segments": segments, "gone": gone, "profiles": [{"name": n, "dimensions": d} for n, d in profiles], "commit": own})
    try:
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("error").text(at)
    except Exception as e:
        if _fs(spark, at)[0].exists(_fs(spark, at)[1]):
            raise Conflict(f"{at} is there already") from e
        raise
    return Store(spark, old.path, version, tuple(segments), tuple(gone), tuple(profiles), own)


# ---- writing ------------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with content_hash, acl and document_key, and their version as a text that isn't null."""
    rows = docs if "store_id" in docs.columns else docs.withColumn("store_id", F.lit(None).cast("string"))
    rows = rows.select(*KEY, "version", "text", *[c for c in SCOPE if c not in KEY])
    rows = rows.withColumn("store_id", F.coalesce("store_id", F.lit(""))).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    rights = F.xxhash64("tenant_id", "instance_id", "active", "level", F.array_sort("groups"), F.array_sort("roles"))
    rows = rows.withColumn("acl", rights).withColumn("document_key", hs.stable_id("doc", *[F.col(c) for c in KEY]))
    return rows.withColumn("_version", F.coalesce(F.col("version").cast("string"), F.lit("")))


def current_keys(docs: DataFrame) -> DataFrame:
    """`current` without the texts, which are not shuffled to find it."""
    rows = _keyed(docs).drop("text")
    latest = Window.partitionBy(*KEY).orderBy(F.col("version").desc_nulls_last(), "content_hash")
    rows = rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    own = ["tenant_id", "instance_id", "store_id", "content_hash"]
    first = rows.groupBy(*own).agg(F.min("document_id").alias("document_id"))
    return rows.join(first, [*own, "document_id"]).drop("_version")


def with_texts(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of `current_keys` with their text: each text that is wanted moves once, to its document's key."""
    own = ["document_key", "_version", "content_hash", "acl"]
    named = keys.withColumn("_version", F.coalesce(F.col("version").cast("string"), F.lit("")))
    return named.join(_keyed(docs).select(*own, "text"), own).dropDuplicates(own).drop("_version")  # rows that are equal in all of it


def current(docs: DataFrame) -> DataFrame:
    """One row of each document, and of each content in a tenant, instance and store: with content_hash, acl and document_key.

    docs: document_id, text, version, the columns of SCOPE, and store_id if there are several.
    """
    return with_texts(current_keys(docs), docs)


def prepare(docs: DataFrame, mode: str = "markdown_docs_v1") -> DataFrame:
    """Chunks of documents as `current` gives them, with ids that depend on document, content and place alone, and their number of terms."""
    keep = [*KEY, "document_key", "version", "content_hash", *[c for c in SCOPE if c not in KEY], "acl"]
    chunks = ck.chunk_documents(docs, keep, mode=mode).drop("severity")
    named = chunks.withColumn("chunk_id", hs.stable_id("chk", *[F.col(c) for c in KEY], F.col("content_hash"), F.col("ordinal")))
    return named.withColumn("terms", F.size(tx.rerank_tokens("text")))


def ingest(
    docs: DataFrame, path: str, mode: str = "markdown_docs_v1", dimensions: int = 64, profile: str = "hash-64", complete: bool = False, embed: Embed = _hash_vectors,
) -> DataFrame:
    """Brings the store at path up to date with docs and returns one row (version, documents, chunks, added, replaced, unchanged).

    complete: documents that aren't among docs go (L5). A profile that the store doesn't have yet is added to all its segments first.
    """
    spark = docs.sparkSession
    old = open_store(spark, path)
    if old.segments and profile not in dict(old.profiles):
        old = add_profile(old, profile, dimensions, embed)
    profiles = old.profiles or ((profile, dimensions),)
    new, known = cut(current_keys(docs)), old.live("documents")
    if known is None:
        todo, gone, same = new, None, 0
    else:
        was = known.select("document_key", F.col("content_hash").alias("_h"), F.col("version").alias("_v"), F.col("acl").alias("_a"), "segment")
        rows = cut(new.join(was, "document_key", "left"))
        changed = F.col("_h").isNull() | ((F.col("_h") != F.col("content_hash")) | (F.col("_a") != F.col("acl"))) & (F.coalesce("version", F.lit(0)) >= F.coalesce("_v", F.lit(0)))
        own = ["tenant_id", "instance_id", "store_id", "content_hash"]
        held = known.join(rows.where("_h is not null").where(changed).select("document_key"), "document_key", "left_anti")
        if complete:
            held = held.join(new.select("document_key"), "document_key", "left_semi")  # what stays
        copies = rows.where("_h is null").join(held.select(*own), own, "left_semi").select("document_key")
        todo = cut(rows.where(changed).join(copies, "document_key", "left_anti"))
        gone = known.join(todo.select("document_key"), "document_key", "left_semi")
        if complete:
            gone = gone.unionByName(known.join(new.select("document_key"), "document_key", "left_anti"))
        gone = cut(gone.distinct())
        same = rows.count() - todo.count()
    n_new, n_gone = todo.count(), 0 if gone is None else gone.count()
    if not n_new and not n_gone:
        state = old if old.version else _commit(old, (), (), profiles)
    else:
        segments, removed = old.segments, old.gone
        if n_gone:
            removed = (*removed, _write_gone(old, gone))
        if n_new:
            segments = (*segments, _write_segment(spark, path, todo.drop("_h", "_v", "_a", "segment"), docs, mode, profiles, embed))
        state = _commit(old, segments, removed, profiles)
    live = state.live("documents")
    counts = spark.range(1).select(F.lit(0).alias("documents"), F.lit(0).alias("chunks")) if live is None else live.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return counts.select(F.lit(state.version).alias("version"), "documents", "chunks", F.lit(n_new).alias("added"), F.lit(n_gone).alias("replaced"), F.lit(same).alias("unchanged"))


def remove(spark: SparkSession, path: str, documents: DataFrame) -> Store:
    """Takes documents (the columns of KEY; store_id may be left out) out of the store."""
    old = open_store(spark, path)
    known = old.live("documents")
    if known is None:
        return old
    gone = cut(known.join(documents, [c for c in KEY if c in documents.columns], "left_semi"))
    return _commit(old, old.segments, (*old.gone, _write_gone(old, gone)), old.profiles) if not gone.isEmpty() else old


def _write_segment(spark: SparkSession, path: str, keys: DataFrame, docs: DataFrame, mode: str, profiles: tuple, embed: Embed) -> str:
    name = f"s{uuid.uuid4().hex}"
    _write_chunks(prepare(with_texts(keys, docs), mode), path, name)
    chunks = spark.read.parquet(f"{path}/chunks/segment={name}")
    counts = chunks.groupBy("document_key").agg(F.count(F.lit(1)).alias("chunks"), F.sum("terms").alias("terms"))
    documents = keys.join(counts, "document_key", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chunks", "terms")})
    documents.write.parquet(f"{path}/documents/segment={name}")
    _write_index(spark, path, name)
    for profile, dimensions in profiles:
        _write_vectors(chunks, path, name, profile, embed(F.col("text"), profile, dimensions))
    return name


def _write_chunks(chunks: DataFrame, path: str, segment: str) -> None:
    chunks.sortWithinPartitions("chunk_id").write.option("compression", "zstd").parquet(f"{path}/chunks/segment={segment}")


def _write_index(spark: SparkSession, path: str, segment: str) -> None:
    chunks = spark.read.parquet(f"{path}/chunks/segment={segment}")
    lx.write_where_made(lx.chunk_blocks(chunks, ["acl"]), f"{path}/postings/segment={segment}")


def _write_vectors(chunks: DataFrame, path: str, segment: str, profile: str, vector: Column) -> None:
    """A profile's vectors in as many files as their rows need, each by rights, so that a search's literals prune."""
    rows = chunks.select("chunk_id", "acl", vector.alias("embedding"))
    files = -(-chunks.count() // FILE_ROWS) or 1
    rows.repartition(files, "chunk_id").sortWithinPartitions("acl", "chunk_id").write.mode("overwrite").parquet(f"{path}/vectors/segment={segment}/profile={profile}")


def _write_gone(old: Store, documents: DataFrame) -> str:
    """What of the store's segments is gone: documents, their chunks, and their chunks' number by term and rights."""
    name = f"s{uuid.uuid4().hex}"
    at = f"{old.path}/gone/{name}"
    documents.select("segment", "document_key", "acl", "chunks", "terms").write.parquet(f"{at}/documents")
    chunks = old.table("chunks").join(documents.select("segment", "document_key"), ["segment", "document_key"], "left_semi")
    chunks.select("segment", "chunk_id").write.parquet(f"{at}/chunks")
    terms = chunks.select("acl", F.explode(F.array_distinct(tx.rerank_tokens("text"))).alias("term"))
    terms.groupBy("term", "acl").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{at}/terms")
    return name


def add_profile(old: Store, profile: str, dimensions: int, embed: Embed = _hash_vectors) -> Store:
    """Vectors of a further embedding profile for every segment; those of the others stay as they are."""
    for s in old.segments:
        _write_vectors(old.spark.read.parquet(f"{old.path}/chunks/segment={s}"), old.path, s, profile, embed(F.col("text"), profile, dimensions))
    return _commit(old, old.segments, old.gone, (*old.profiles, (profile, dimensions)))


def compact(spark: SparkSession, path: str) -> Store:
    """One segment of all that is live. Nothing is chunked or embedded again."""
    old = open_store(spark, path)
    if not old.segments or (len(old.segments) == 1 and not old.gone):
        return old
    name = f"s{uuid.uuid4().hex}"
    for table in ("documents", "chunks"):
        rows = old.live(table).drop("segment")
        if table == "chunks":
            _write_chunks(rows.repartition("document_key"), path, name)
        else:
            rows.write.parquet(f"{path}/{table}/segment={name}")
    _write_index(spark, path, name)
    gone = old.removed("chunks")
    for profile, _ in old.profiles:
        rows = _vectors(old, profile)
        rows = rows if gone is None else rows.join(gone, ["segment", "chunk_id"], "left_anti")
        _write_vectors(rows, path, name, profile, F.col("embedding"))
    return _commit(old, (name,), (), old.profiles)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes what none of the last `keep` manifests names, and the manifests before them."""
    known = manifests(spark, path)
    kept = [open_store(spark, path, v) for v in known[-keep:]]
    segments, gone = {s for k in kept for s in k.segments}, {g for k in kept for g in k.gone}
    for v in known[:-keep]:
        remove_folder(spark, f"{path}/manifest/v{v}")
    for table, used in (("chunks", segments), ("documents", segments), ("postings", segments), ("vectors", segments), ("gone", gone)):
        fs, at = _fs(spark, f"{path}/{table}")
        for s in fs.listStatus(at) if fs.exists(at) else ():
            if (n := s.getPath().getName()).removeprefix("segment=") not in used:
                remove_folder(spark, f"{path}/{table}/{n}")


# ---- reading ------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _vectors(store: Store, profile: str) -> DataFrame:
    at = [f"{store.path}/vectors/segment={s}/profile={profile}" for s in store.segments]
    return store.spark.read.option("basePath", f"{store.path}/vectors").parquet(*at).drop("profile")


@dataclass(frozen=True)
class Reach:
    """What a caller may read of a store: a predicate or a table of `acl`, and the chunks and terms in it."""

    few: tuple[int, ...] | None
    table: DataFrame
    chunks: float
    terms: float

    def within(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, "acl", "left_semi") if self.few is None else df.where(F.col("acl").isin(list(self.few)))


@lru_cache(maxsize=256)
def reach(store: Store, principal: Principal) -> Reach:
    docs = scoped(store.live("documents").withColumnRenamed("level", "security_level"), principal).withColumnRenamed("security_level", "level")
    own = docs.where(acl_allowed(F.col("level"), F.col("groups"), F.col("roles"), principal)).groupBy("acl").agg(F.sum("chunks").alias("chunks"), F.sum("terms").alias("terms"))
    rows = own.limit(FEW_ACLS + 1).collect()
    if len(rows) <= FEW_ACLS:
        return Reach(tuple(r.acl for r in rows), own.select("acl"), float(sum(r.chunks for r in rows)), float(sum(r.terms for r in rows)))
    own = cut(own)
    total = own.agg(F.sum("chunks"), F.sum("terms")).first()
    return Reach(None, own.select("acl"), float(total[0]), float(total[1]))


def query_vectors(store: Store, queries: DataFrame, profile: str, dimensions: int, embed: Embed = _hash_vectors, remember: bool = False) -> DataFrame:
    """(query_id, embedding) of queries under a profile. remember: texts are embedded once a profile and dimension, and kept with the store."""
    if not remember:
        return queries.select("query_id", embed(F.col("text"), profile, dimensions).alias("embedding"))
    at = f"{store.path}/query_vectors/{profile}-{dimensions}"
    fs, folder = _fs(store.spark, at)
    asked = queries.select("query_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    texts = asked.select("text_hash", "text").dropDuplicates(["text_hash"])
    if fs.exists(folder):
        texts = texts.join(store.spark.read.parquet(at).select("text_hash"), "text_hash", "left_anti")
    texts.select("text_hash", embed(F.col("text"), profile, dimensions).alias("embedding")).write.mode("append").parquet(at)
    return asked.select("query_id", "text_hash").join(store.spark.read.parquet(at).dropDuplicates(["text_hash"]), "text_hash").select("query_id", "embedding")


def search(
    store: Store, queries: DataFrame, k: int, principal: Principal, profile: rt.Profile = rt.PROFILES["hybrid_rrf_secure_v2"], profiles: list[str] | None = None,
    embed: Embed = _hash_vectors, remember: bool = False,
) -> DataFrame:
    """The whole search over a store as one caller (R4-R11): scope and rights before any top k, and again on what is shown.

    queries: (query_id, text). Each embedding profile of the store, or those named, is searched in its own dimensions and their lists are
    fused by rank before the words' list joins (R4).
    """
    if not store.segments:
        names = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", "chunk_id string", "document_id string", "rank int", "score double", "text string", "level int"]
        return store.spark.createDataFrame([], ", ".join(names))
    dense_k, sparse_k, fused_k = profile.depths(k)
    mine, gone = reach(store, principal), store.removed("chunks")
    index = mine.within(store.table("postings").drop("folder"))
    index = index.select("term", "acl", "segment", "slice", "block", *[c for c in index.columns if c not in ("term", "acl", "segment", "slice", "block")])
    few_terms = rt.query_terms(queries).limit(FEW_TERMS + 1).collect()
    few = len(few_terms) <= FEW_TERMS
    small = few and len(few_terms) * len(mine.few or range(FEW_ACLS)) * (1 + mine.chunks / lx.BLOCK) <= lx.FEW_BLOCKS
    dead_terms = None if gone is None else mine.within(store.removed("terms"))
    by, asked = (lx.search_few, few_terms) if small else (lx.search, queries)
    sparse = by(asked, index, mine.chunks, mine.terms / max(mine.chunks, 1.0), sparse_k, dead=gone, dead_terms=dead_terms)
    lists = []
    for name, dimensions in store.profiles:
        if profiles is None or name in profiles:
            rows = mine.within(_vectors(store, name))
            rows = rows if gone is None else rows.join(gone, ["segment", "chunk_id"], "left_anti")
            lists.append(rt.dense_search(query_vectors(store, queries, name, dimensions, embed, remember), rows, dense_k))
    dense = rt.rrf(lists) if len(lists) > 1 else lists[0]
    dense, sparse = (x.coalesce(1) if few else x for x in (dense, sparse))  # lists of few queries are short
    fused = rt.rrf([dense, sparse], rt.fusion_weights(profile), profile.rrf_k, fused_k)
    fused = fused if few else cut(fused)
    chunks, rows = store.live("chunks"), fused.limit(FEW_ROWS + 1).collect()
    if len(rows) <= FEW_ROWS:  # texts of what was found alone, by literals; from here on one task has it all
        fused = store.spark.createDataFrame(rows, fused.schema).coalesce(1)
        chunks = F.broadcast(cut(chunks.where(F.col("chunk_id").isin(sorted({r.chunk_id for r in rows})))).coalesce(1))
    found = rt.rank_candidates(fused, chunks, queries.coalesce(1) if few else queries, k, profile)
    hits = found.select("query_id", "rank", "chunk_id", "score")
    shown = hits.join(chunks.drop("terms", "document_key", "acl", "segment"), "chunk_id")
    return shown.where(acl_allowed(F.col("level"), F.col("groups"), F.col("roles"), principal))


def stored_search(spark: SparkSession, path: str, queries: DataFrame, k: int, principal: Principal, profile: rt.Profile = rt.PROFILES["hybrid_rrf_secure_v2"], **options) -> DataFrame:
    """`search` over the store at a path, as its last manifest names it."""
    return search(open_store(spark, path), queries, k, principal, profile, **options)
