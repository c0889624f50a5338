"""The pipeline's rows against plain versions of its stages, and the contract queries against their SQL."""

import os
import re
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import duckdb
import pytest

import corpus_pipeline
from brindle.llm import mixing, oracles, queries
from tests.llm.test_operators import LOW, brute_components


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        at = os.path.join(spark.conf.get("spark.checkpoint.dir"), "test-" + name.replace(" ", "-"))
        got.write.mode("overwrite").parquet(at)
        before, docs = docs, spark.read.parquet(at)
        seen[name] = (before, docs)
        assert docs.columns == before.columns + (["shard", "slot"] if name == "sharding" else [])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in x.collect()} for x in seen["quality classifier"])
    assert sum(labels.get(i) == 1 for i in before - after) <= 0.02 * len(before)
    before, after = seen["near-dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {d for d, _, c, _ in brute_components(rows, 5, 80) if d == c}
    before, after = seen["decontamination"]
    windows = set()
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = alnum(r.text)
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} - {()}
    hit = lambda w: any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not hit(alnum(r.text))}
    before, after = seen["mixing"]
    words, sums = Counter(), Counter()
    for table, into in ((before, words), (after, sums)):
        for r in table.collect():
            into[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    target = {r.source: r.target for r in mixing.mix(before).join(before.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    assert all(sums[x] <= 2 * words[x] and abs(sums[x] - target[x]) <= 0.05 * target[x] + 60 for x in words)
    copies = Counter(r.doc_id for r in after.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in before.collect()}
    _, out = seen["sharding"]
    slots = defaultdict(list)
    for r in out.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == after.count()
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    shared = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    there = set(shared.iterdir()) if shared.exists() else set()
    last = corpus_pipeline.run(spark, sf)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in out.collect())
    assert len(set(shared.iterdir()) - there) == 1  # of all tables made on the way the last stage's stays


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({oracles.oracle_sql()[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)
