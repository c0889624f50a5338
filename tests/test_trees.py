"""Digests of trees of any depth, whole and after a change."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import graph as gr

NODES = "id int, parent int, ordinal int, content string, level int"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain(rows):
    kids = {}
    for i, p, o, *_ in rows:
        kids.setdefault(p, []).append((o, i))
    content = {r[0]: r[3] for r in rows}
    out = {}
    for i, *_ in sorted(rows, key=lambda r: -r[4]):
        out[i] = sha(sha(content[i] or "") + "".join(out[k] for _, k in sorted(kids.get(i, []))))
    return out


def tree(depth, width, seed=3):
    r = random.Random(seed)
    rows = [(0, None, 0, "root", 0)]
    for d in range(1, depth):
        above = [x[0] for x in rows if x[4] == d - 1]
        rows += [(len(rows) + k, r.choice(above), r.randrange(2), r.choice(["a", "b", None]), d) for k in range(r.randint(1, width))]
    return rows


def test_any_depth_and_one_changed_leaf(spark):
    rows = tree(15, 4)
    df = spark.createDataFrame(rows, NODES).repartition(3)
    old = df.sparkSession.createDataFrame(list(plain(rows).items()), "id int, hash string")
    assert {r.id: r.hash for r in gr.subtree_hashes(df).collect()} == plain(rows)
    with pytest.raises(ValueError):
        gr.subtree_hashes(df, 14)
    assert gr.subtree_hashes(df.limit(0)).count() == 0
    leaf = max(r[0] for r in rows if r[4] == 14)
    now = [(i, p, o, "changed" if i == leaf else c, d) for i, p, o, c, d in rows]
    up, above = {r[0]: r[1] for r in rows}, set()
    at = leaf
    while at is not None:
        above.add(at)
        at = up[at]
    got = {r.id: r.hash for r in gr.rehash(spark.createDataFrame(now, NODES), old, spark.createDataFrame([(leaf,), (10_000,)], "id int")).collect()}
    assert set(got) == above and all(got[i] == plain(now)[i] for i in above)
    assert gr.rehash(df, old, df.where(F.lit(False)).select("id")).count() == 0
