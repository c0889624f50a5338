"""BM25 over texts without an index gives the rows of the index, and shuffles nothing but each task's best."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from brindle.operators import retrieval as rt


@pytest.mark.parametrize("scores, terms", [(2_000_000, 1_000_000), (50, 6)])
def test_the_rows_of_the_index(spark, monkeypatch, scores, terms):
    monkeypatch.setattr(rt, "SCORES", scores)
    monkeypatch.setattr(rt, "QUERY_TERMS", terms)
    r = random.Random(3)
    texts = [" ".join(r.choices([f"w{i}" for i in range(30)], k=r.randint(1, 40))) + " The END" for _ in range(150)]
    rows = [(f"c{i:03}", t) for i, t in enumerate(texts + texts[:40] + texts[:40] + ["w1 w2"] * 60)] + [("n", None), ("e", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)
    queries = spark.createDataFrame([(1, "w0 w3 w3 end"), (2, "w1"), (3, "w5 w6 w7 w8 absent"), (4, "nothing"), (5, ""), (6, "W1, w2")], "query_id int, text string")
    index = rt.postings(chunks)
    key = lambda df: sorted((x.query_id, x["rank"], x.chunk_id, round(x.score, 6)) for x in df.collect())
    for k in (1, 7, 1000):
        assert key(rt.bm25_texts(queries, chunks, k)) == key(rt.bm25(queries, index, rt.collection_size(index, chunks), k))


def test_candidates_do_not_shuffle_postings_or_texts(spark, sf):
    plan = entry.queries()["result_page"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.lower().count("strategy=broadcast") == 2
