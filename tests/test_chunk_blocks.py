"""Blocks are made where the chunks are, and a web search deals postings once, by chunk."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import lexical_index as lx


def texts(n):
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    return [(i, f"t{i % 3}", " ".join(r.choices(words, [1 / (j + 1) for j in range(40)], k=r.randint(1, 60))) + " The END") for i in range(n)] + [(n, "t0", None), (n + 1, "t1", "")]


@pytest.mark.parametrize("shard", [16_384, 7])
def test_blocks_of_chunks_are_those_of_postings(spark, monkeypatch, tmp_path, shard):
    monkeypatch.setattr(lx, "SHARD", shard)
    monkeypatch.setattr(lx, "BLOCK", 4)
    monkeypatch.setattr(lx, "BATCH", 10)
    chunks = spark.createDataFrame(texts(200), "chunk_id long, acl string, text string").repartition(3)
    made = lx.chunk_blocks(chunks, ["acl"])
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    lx.write_where_made(made, str(tmp_path / "i"))
    rows = lx.read(spark, str(tmp_path / "i"))
    flat = rows.select("term", "acl", F.explode(F.arrays_zip("chunks", "tfs", "lengths", "positions")).alias("z")).select("term", "acl", "z.*")
    got = Counter((x.term, x.acl, x.chunks, x.lengths, x.tfs, tuple(x.positions)) for x in flat.collect())
    assert got == Counter((x.term, x.acl, x.chunk_id, x.length, x.tf, tuple(x.positions)) for x in lx.postings(chunks, ["acl"]).collect())
    for b in rows.collect():
        assert b.n == len(b.chunks) <= 4 and b.max_tf == max(b.tfs) and b.min_length == min(b.lengths) and b.chunks == sorted(b.chunks)
    assert rows.select("term", "acl", "slice", "block").distinct().count() == rows.count()


def test_a_web_search_deals_postings_once(spark):
    index = lx.chunk_blocks(spark.createDataFrame(texts(60), "chunk_id long, acl string, text string"))
    asked = spark.createDataFrame([(1, '"w0 w1" w2 -w3 or w5'), (2, "w1 w2")], "query_id int, text string")
    plan = lx.web_search(asked, index, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == plan.count("Window [row_number()")  # that of the ranking alone
