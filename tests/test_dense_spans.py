"""Dense searches hold the scores of a bounded span of queries at a time, whatever the number of queries, and find the same."""

from __future__ import annotations

import numpy as np

from brindle.lineage import new_folder
from brindle.operators import dense_index as di
from brindle.operators import retrieval as rt


def test_scores_of_a_batch_come_in_bounded_spans(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 8)).round(1)
    v[200:230] = v[7]  # equal scores
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)], "chunk_id long, label int, embedding array<double>").repartition(2).cache()
    queries = rows.where("chunk_id % 4 = 0").selectExpr("chunk_id as query_id", "embedding")
    di.build(rows, at := new_folder(spark), keep=["label"], lists=4)
    found = lambda: [
        sorted(map(tuple, x.selectExpr("query_id", "chunk_id", "rank", "round(score, 9) as score").collect()))
        for x in (rt.dense_search(queries, rows, 5), rt.dense_search(queries, rows, 2, by=["label"]), di.search(spark, at, queries, 5, 4), di.search(spark, at, queries, 5, 2, 40))
    ]
    want = found()
    assert all(len(x) > 0 for x in want)
    assert list(rt.query_spans(10, 1_000_000)) == [(i, i + 2) for i in range(0, 10, 2)]
    monkeypatch.setattr(rt, "SCORES", 600)
    assert found() == want
    assert max(b - a for a, b in rt.query_spans(100, 200)) * 200 <= 600
