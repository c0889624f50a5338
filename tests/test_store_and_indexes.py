"""Indexes and the store against plain versions: ranks over many partitions, recall, blocks, positions, segments, profiles, rights."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import dense_index as di
from brindle.operators import ingest as ig
from brindle.operators import lexical_index as lx
from brindle.operators import paging as pg
from brindle.operators import retrieval as rt
from brindle.operators.security import Principal


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ranks_of_a_million_rows_in_64_partitions(spark, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    try:
        for k, v in zip(old, (adaptive, "64", "256k", "false")):
            spark.conf.set(k, v)
        rows = spark.range(1_000_000).withColumn("x", F.when(F.col("id") % 3 == 0, 7).otherwise((F.col("id") * 7919) % 1_000_003))  # a third has one key
        got = pg.global_rank(rows, [F.col("x").desc()], "n")
        s = got.agg(F.count(F.lit(1)), F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("id")).first()
        assert tuple(s) == (1_000_000, 1_000_000, 1, 1_000_000, 1_000_000)
        runs = got.groupBy("x").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.count(F.lit(1)).alias("k"))
        assert runs.where("b - a + 1 <> k").count() == 0
        edges = [(r.x, r.a) for r in runs.orderBy(F.desc("x")).limit(2000).collect()]
        assert [a for _, a in edges] == sorted(a for _, a in edges)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_dense_index_finds_nine_of_ten_and_reads_fewer_files(spark, tmp_path):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(24)] for _ in range(30)]
    rows = [(i, [c + r.gauss(0, 0.35) for c in centres[i % 30]], i % 3) for i in range(6000)] + [(7000, None, 1), (7001, [0.0] * 24, 1)]
    table = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, tenant int")
    at = str(tmp_path / "index")
    di.build(table, at, keep=["tenant"], lists=32)
    q = table.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = rt.dense_search(q, table, 10).cache()
    every = di.search(spark, at, q, 10, 32)
    key = lambda df: Counter((x.query_id, x.chunk_id, round(x.score, 9), x["rank"]) for x in df.collect())
    assert key(every) == key(exact)
    probes, depth = di.tuned(spark, at, 10)
    assert probes <= 8 and depth <= 300
    near = di.search(spark, at, q, 10, probes, depth)
    assert di.recall(near, exact).first().recall >= 0.9
    one = q.where("query_id = 50")
    unit = di._unit(np.array([one.first().embedding], float))
    read = lambda n: spark.read.parquet(f"{at}/lists").where(F.col("list").isin(*map(int, di.open_quantiser(spark, at).probes(unit, n)[0]))).select(F.input_file_name()).distinct().count()
    files = [read(n) for n in (1, 4, 32)]
    assert files[0] < files[1] < files[2]
    own = di.search(spark, at, q, 10, 32, allowed=spark.createDataFrame([(1,)], "tenant int"))
    assert key(own) == key(rt.dense_search(q, table.where("tenant = 1"), 10))
    di.add(spark.createDataFrame([(9000, 0, [float(x) for x in centres[0]])], "chunk_id long, tenant int, embedding array<double>"), at, ["tenant"])
    asked = spark.createDataFrame([(1, [float(x) for x in centres[0]])], "query_id int, embedding array<double>")
    assert di.search(spark, at, asked, 1, 2, 200).first().chunk_id == 9000
    di.build(table.limit(0), str(tmp_path / "none"))
    assert di.open_quantiser(spark, str(tmp_path / "none")).centres.shape[0] == 1


def texts(n, seed=1, vocab=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    return [(i, " ".join(r.choices(words, [1 / (j + 1) for j in range(vocab)], k=r.randint(1, 80)))) for i in range(n)]


@pytest.mark.parametrize("block, slice_", [(128, 65_536), (4, 30)])
def test_blocks_give_the_rows_of_bm25_and_skip_some(spark, monkeypatch, tmp_path, block, slice_):
    monkeypatch.setattr(lx, "BLOCK", block)
    monkeypatch.setattr(lx, "SLICE", slice_)
    chunks = spark.createDataFrame(texts(400) + [(1000, None), (1001, "")], "chunk_id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "w0 w30 w45"), (2, "w1"), (3, "w50 w51 w0 w0"), (4, "nothing here"), (5, ""), (6, "w59")], "query_id int, text string")
    plain = rt.postings(chunks)
    size = rt.collection_size(plain, chunks).first()
    rows = lx.postings(chunks)
    lx.write(lx.blocks(rows), str(tmp_path / "i"), rows.count())
    index = lx.read(spark, str(tmp_path / "i"))
    key = lambda df: Counter((x.query_id, x.chunk_id, x.score, x["rank"]) for x in df.collect())
    for k in (3, 10, 1000):
        assert key(lx.search(q, index, size.n, size.mean_length, k)) == key(rt.bm25(q, plain, rt.collection_size(plain, chunks), k))
    if block == 4:
        wanted, _ = lx.needed(q.where("query_id = 2"), index, size.n, size.mean_length, 3)
        whole = index.join(rt.query_terms(q.where("query_id = 2")), "term").agg(F.sum("n")).first()[0]
        assert wanted.agg(F.sum("n")).first()[0] < 0.8 * whole
        assert index.where("term = 'w0'").select("slice").distinct().count() > 5  # a hot term is in many parts


def plain_web(query, docs, k):
    import re

    alternatives, stop = [[]], set(rt.tx.STOPWORDS)
    for part in re.findall(r'-?"[^"]*"|\S+', query):
        if part.lower() == "or":
            alternatives.append([])
            continue
        words = [w for w in re.findall("[a-z0-9]+", part.lower()) if w not in stop]
        if words:
            alternatives[-1].append((part.startswith("-"), words))
    out = {}
    for i, text in docs:
        t = [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in stop]
        starts = lambda ws: [p for p in range(len(t) - len(ws) + 1) if t[p : p + len(ws)] == ws]
        for alt in alternatives:
            want = [starts(ws) for neg, ws in alt if not neg]
            if not want or not all(want) or any(starts(ws) for neg, ws in alt if neg):
                continue
            ends = sorted({p for s in want for p in s})
            cover = {}
            for e in ends:
                if all(s[0] <= e for s in want):
                    b = min(max(p for p in s if p <= e) for s in want)
                    cover.setdefault(b, e)
            score = sum(0.1 / (1 + max(0, e - b - (len(want) - 1))) for b, e in cover.items())
            out[i] = max(out.get(i, 0), round(score, 9))
    return [(i, round(s, 6)) for i, s in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:k]]


def test_web_searches_with_phrases_exclusions_and_alternatives(spark):
    docs = texts(200, 3, 12) + [(900, None), (901, "The red fox, the RED fox"), (902, "red the fox"), (903, "fox red")]
    index = lx.blocks(lx.postings(spark.createDataFrame(docs, "chunk_id long, text string")))
    asked = ['"red fox"', "red fox", '"w0 w1" w2 -w3', '"w0 w0" or "w4 w5 w1"', "-w1", 'w7 w7 -"w1 w2"', "or", "", "the", '"unclosed w1', "w1 w2 w3 w4 w5", 'w0 OR w11 or -w2', 'fox "red fox"']
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")
    got = {}
    for r in lx.web_search(q, index, 15).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for i, text in enumerate(asked):
        assert got.get(i, []) == plain_web(text, docs, 15), text


# ---- the store ----------------------------------------------------------------------------------------------------------

DOCS = "document_id string, text string, version int, tenant_id string, instance_id string, active boolean, level int, groups array<string>, roles array<string>, store_id string"


def doc(i, text, version=1, tenant="t", instance="i", level=1, store="s"):
    return (i, text, version, tenant, instance, True, level, [], [], store)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def live(spark, at, version=None):
    return {(r.tenant_id, r.instance_id, r.store_id, r.document_id, r.version) for r in ig.open_store(spark, at, version).live("documents").collect()}


ASK = "query_id int, text string"


def hits(spark, at, text="fox", tenant="t", instance="i", **options):
    q = spark.createDataFrame([(1, text)], ASK)
    return [(r.document_id, round(r.score, 6)) for r in ig.stored_search(spark, at, q, 10, Principal(tenant, instance), **options).orderBy("rank").collect()]


def test_documents_of_other_tenants_instances_and_stores_stay(spark, tmp_path):
    at = str(tmp_path / "store")
    rows = [doc("d1", "a red fox"), doc("d1", "a red fox", tenant="u"), doc("d2", "a red fox", instance="j"), doc("d3", "a red fox", store="z"), doc("d4", "a red fox"), doc("d5", "old fox", 1), doc("d5", "new fox", 2), doc("d6", "tie a", 1), doc("d6", "tie b", 1)]
    assert tuple(ig.ingest(table(spark, *rows), at).first())[1] == 6
    assert live(spark, at) == {("t", "i", "s", "d1", 1), ("u", "i", "s", "d1", 1), ("t", "j", "s", "d2", 1), ("t", "i", "z", "d3", 1), ("t", "i", "s", "d5", 2), ("t", "i", "s", "d6", 1)}
    assert {d for d, _ in hits(spark, at, "fox", instance="j")} == {"d2"}


def test_only_what_changed_is_written_and_readers_keep_their_manifest(spark, tmp_path):
    at = str(tmp_path / "store")
    ig.ingest(table(spark, *[doc(f"d{i}", f"the fox number {i} runs") for i in range(6)]), at)
    before = ig.open_store(spark, at)
    q = spark.createDataFrame([(1, "fox number 3")], ASK)
    old_hits = ig.search(before, q, 10, Principal("t", "i")).collect()
    r = ig.ingest(table(spark, doc("d3", "the wolf number 3 sleeps", 2), doc("d4", "the fox number 4 runs", 2), doc("d9", "the fox number 5 runs"), doc("d2", "older text", 0)), at).first()
    assert (r.version, r.added, r.replaced) == (2, 1, 1)  # d4 is as it was, d9 has d5's content, d2's version is older
    now = ig.open_store(spark, at)
    assert now.segments[:-1] == before.segments and now.table("chunks").where(F.col("segment") == now.segments[-1]).count() == 1
    assert "d3" not in {d for d, _ in hits(spark, at, "fox")[:5]} and hits(spark, at, "wolf sleeps")[0][0] == "d3"
    assert sorted(map(tuple, ig.search(before, q, 10, Principal("t", "i")).collect())) == sorted(map(tuple, old_hits))
    ig.remove(spark, at, spark.createDataFrame([("t", "i", "d1")], "tenant_id string, instance_id string, document_id string"))
    assert {k[3] for k in live(spark, at)} == {"d0", "d2", "d3", "d4", "d5"}
    ig.ingest(table(spark, doc("d1", "the fox number 1 runs")), at)  # comes back with the text it had
    assert "d1" in {d for d, _ in hits(spark, at, "fox number 1")}
    ig.ingest(table(spark, doc("d0", "the fox number 0 runs"), doc("d7", "a new fox")), at, complete=True)
    assert {k[3] for k in live(spark, at)} == {"d0", "d7"}
    # scores are those of a store that never had the others, before and after compaction
    fresh = str(tmp_path / "fresh")
    ig.ingest(table(spark, doc("d0", "the fox number 0 runs"), doc("d7", "a new fox")), fresh)
    want = hits(spark, fresh)
    assert hits(spark, at) == want
    ig.compact(spark, at)
    assert hits(spark, at) == want and len(ig.open_store(spark, at).segments) == 1
    assert {k[3] for k in live(spark, at, 1)} == {f"d{i}" for i in range(6)}
    ig.vacuum(spark, at)
    assert hits(spark, at) == want and ig.manifests(spark, at) == [ig.open_store(spark, at).version]
    assert ig.ingest(table(spark), at).first().added == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    at = str(tmp_path / "store")
    ig.ingest(table(spark, doc("a", "one fox")), at)
    mine = ig.open_store(spark, at)
    ig.ingest(table(spark, doc("b", "two foxes")), at)
    with pytest.raises(ig.Conflict):
        ig._commit(mine, mine.segments, mine.gone, mine.profiles)
    assert {k[3] for k in live(spark, at)} == {"a", "b"}


def test_an_empty_store_and_empty_texts(spark, tmp_path):
    at = str(tmp_path / "store")
    assert hits(spark, at) == []
    ig.ingest(table(spark), at)
    assert hits(spark, at) == []
    ig.ingest(table(spark, doc("a", None), doc("b", ""), doc("c", "fox", level=None)), at)
    assert {k[3] for k in live(spark, at)} == {"a", "c"} and hits(spark, at) == []


def test_profiles_of_several_dimensions_in_one_store(spark, tmp_path):
    at = str(tmp_path / "store")
    docs = table(spark, *[doc(f"d{i}", f"fox {i} of many words") for i in range(12)])
    ig.ingest(docs, at)
    one = hits(spark, at)
    ig.ingest(docs, at, profile="hash-32", dimensions=32)
    ig.ingest(table(spark, doc("d20", "fox 20 of many words")), at)
    assert ig.open_store(spark, at).profiles == (("hash-64", 64), ("hash-32", 32))
    two = hits(spark, at)
    assert len(two) == 10 == len({d for d, _ in two}) and len(one) == 10
    # both lists are fused by rank
    store, q = ig.open_store(spark, at), spark.createDataFrame([(1, "fox 3")], ASK)
    lists = [rt.dense_search(ig.query_vectors(store, q, n, d), ig._vectors(store, n), 8) for n, d in store.profiles]
    want = rt.rrf(lists).collect()
    assert len(want) >= 8 and {r.query_id for r in want} == {1}
    only = hits(spark, at, profiles=["hash-32"])
    assert len(only) == 10
    for _ in range(2):
        assert hits(spark, at, remember=True) == two
    kept = spark.read.parquet(f"{at}/query_vectors/hash-32-32")
    assert kept.count() == 1


def test_no_score_tells_of_hidden_documents(spark, tmp_path):
    at, other = str(tmp_path / "a"), str(tmp_path / "b")
    open_ = [doc("d1", "a red fox"), doc("d2", "a grey fox and a hen"), doc("d3", "the hen")]
    ig.ingest(table(spark, *open_), at)
    ig.ingest(table(spark, *open_, doc("h1", "fox " * 50, level=4), doc("h2", "hidden hen", level=4), doc("u", "fox hen", tenant="u")), other)
    assert hits(spark, at, "fox hen") == hits(spark, other, "fox hen")
