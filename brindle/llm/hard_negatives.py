"""Hard negatives by dual-tree search: a tree over the anchors, trees over the candidates, and intervals of the inner product between nodes.

A row of `rows` is (vec_id, label, q): whole numbers, scored exactly by their inner product with an anchor's. For each anchor the first
positives (other rows of its label) are found, then for each positive the first negatives (rows of other labels) whose score lies in a
window below the positive's. Higher scores come first, ties by smaller vec_id.

*   Every node knows its centre and radius and the least and greatest number in each place, which bound the inner products of all pairs
    of two nodes from both sides. A pair of nodes whose interval lies below what all anchors of the one still need, or above all their
    windows, is left with everything under it; what remains goes down, and pairs of leaves are scored exactly, the most promising first.
*   The top of the candidates' tree is their layout: rows are dealt to the nearest of a bounded number of pivots and lie in files by
    pivot, so that a task's rows are near each other. Below, a task builds a tree for each CHUNK_ROWS rows. The layout never decides a
    result. Many equal vectors are split over tasks by their ids.
*   Anchors are taken in blocks of BLOCK_NUMBERS numbers, by the order of the layout, and sent to the tasks: one scan of the candidates
    finds a block's positives, another its negatives. What a task sends back is the first k rows of each window.

Rows equal in vec_id, label and numbers count once. A null vec_id takes no part. A vector shorter than another counts as followed by
zeros. Scores are exact while they are under 2**63. Fewer rows than asked for are returned where there are no more; empty tables give
none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.session import append, cut, new_table

#: Pivots of the layout, numbers of a block of anchors, rows of a candidates' tree, rows of a leaf on either side.
PIVOTS, BLOCK_NUMBERS, CHUNK_ROWS, CANDIDATE_LEAF, ANCHOR_LEAF = 64, 2_000_000, 16_384, 256, 64
_EXACT = 2.0**53


def quantised(vectors: DataFrame, label: Column | None = None, scale: int = 256) -> DataFrame:
    """(vec_id, label, q) of vectors (vec_id, embedding, label): each component x as floor(scale * x). Rows with a null id, label or vector
    or a component that is null or not finite are left out."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    ok = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return ok.select(F.col("vec_id").cast("long"), (F.col("label") if label is None else label).cast("long").alias("label"), q.alias("q"))


# ---- trees --------------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Rows in the order of the leaves, and nodes: the part of the rows, children (-1: a leaf) and bounds."""

    order: np.ndarray
    start: list[int] = field(default_factory=list)
    stop: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    bounds: dict[str, np.ndarray] = field(default_factory=dict)


def build(x: np.ndarray, label: np.ndarray, ids: np.ndarray, leaf: int) -> Tree:
    """Splits by label while a node has several, then by the place of the widest spread at its median; leaves are in order of ids."""
    t = Tree(np.arange(len(x)))
    parts: dict[str, list] = {"centre": [], "radius": [], "low": [], "high": [], "first": [], "last": []}

    def node(a: int, b: int) -> int:
        own = t.order[a:b]
        rows, labels = x[own], label[own]
        low, high, centre = rows.min(0), rows.max(0), rows.mean(0)
        n = len(t.start)
        for name, v in (("centre", centre), ("radius", np.sqrt(((rows - centre) ** 2).sum(1).max())), ("low", low), ("high", high), ("first", labels.min()), ("last", labels.max())):
            parts[name].append(v)
        for column, v in ((t.start, a), (t.stop, b), (t.left, -1), (t.right, -1)):
            column.append(v)
        cutting = labels if labels.min() < labels.max() else rows[:, np.argmax(high - low)] if rows.shape[1] else labels
        if b - a <= leaf or cutting.min() == cutting.max():
            t.order[a:b] = own[np.argsort(ids[own], kind="stable")]
            if b - a > leaf:  # equal vectors of one label: as many leaves as they need
                middle = (a + b) // 2
                t.left[n], t.right[n] = node(a, middle), node(middle, b)
            return n
        value = np.median(cutting)
        below = cutting < value if (cutting < value).any() else cutting <= value
        t.order[a:b] = np.concatenate([own[below], own[~below]])
        middle = a + int(below.sum())
        t.left[n], t.right[n] = node(a, middle), node(middle, b)
        return n

    if len(x):
        node(0, len(x))
    t.bounds = {k: np.array(v) for k, v in parts.items()}
    t.bounds["norm"] = np.sqrt((t.bounds["centre"] ** 2).sum(-1)) if len(x) else np.zeros(0)
    return t


def _intervals(a: Tree, i: np.ndarray, c: Tree, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of all inner products between the nodes i of one tree and j of the other."""
    p, q = a.bounds, c.bounds
    middle = np.einsum("nd,nd->n", p["centre"][i], q["centre"][j])
    reach = p["radius"][i] * q["norm"][j] + q["radius"][j] * p["norm"][i] + p["radius"][i] * q["radius"][j]
    low, high = middle - reach, middle + reach
    corners = [p[s][i] * q[t][j] for s in ("low", "high") for t in ("low", "high")]
    low = np.maximum(low, np.minimum.reduce(corners).sum(1))
    high = np.minimum(high, np.maximum.reduce(corners).sum(1))
    slack = 0.5 + 1e-9 * (p["radius"][i] + p["norm"][i]) * (q["radius"][j] + q["norm"][j])  # of rounding
    return low - slack, high + slack


@dataclass
class Anchors:
    """A block of anchors in the order of their tree, and their windows in the same order: (anchor, least and greatest score, key)."""

    tree: Tree
    ids: np.ndarray
    label: np.ndarray
    q: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, label: np.ndarray, q: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray) -> Anchors:
        tree = build(q.astype(np.float64), label, ids, ANCHOR_LEAF)
        place = np.empty(len(ids), np.int64)
        place[tree.order] = np.arange(len(ids))
        by = np.argsort(place[owner], kind="stable")
        return Anchors(tree, ids[tree.order], label[tree.order], q[tree.order], place[owner][by], low[by], high[by], key[by])


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: in doubles where these hold every sum, else in 64-bit integers."""
    if not x.shape[1] or float(np.abs(x).max()) * float(np.abs(y).max()) * x.shape[1] < _EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


_NONE = np.iinfo(np.int64).min


class Best:
    """The first k (score, id) of each window so far."""

    def __init__(self, a: Anchors, same: bool, k: int):
        self.a, self.same, self.k = a, same, k
        self.score = np.full((len(a.owner), k), _NONE)
        self.id = np.full((len(a.owner), k), np.iinfo(np.int64).max)
        self.need = a.low.copy()  # a score under this can't come in

    def search(self, ids: np.ndarray, label: np.ndarray, q: np.ndarray) -> None:
        """Takes in candidates: both trees from their roots down."""
        a, t = self.a, build(q.astype(np.float64), label, ids, CANDIDATE_LEAF)
        if not len(ids) or not len(a.owner):
            return
        ids, label, q = ids[t.order], label[t.order], q[t.order]
        at, ct = a.tree, t
        a_start, a_stop, a_left, a_right = (np.array(v) for v in (at.start, at.stop, at.left, at.right))
        c_left, c_right = np.array(ct.left), np.array(ct.right)
        w_start, w_stop = np.searchsorted(a.owner, a_start), np.searchsorted(a.owner, a_stop)
        node_need = np.array([self.need[s:e].min() if e > s else np.inf for s, e in zip(w_start, w_stop)])
        node_most = np.array([a.high[s:e].max() if e > s else -np.inf for s, e in zip(w_start, w_stop)])
        i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves: list[tuple[float, float, int, int]] = []
        while len(i):
            low, high = _intervals(at, i, ct, j)
            p, c = at.bounds, ct.bounds
            if self.same:
                fits = (p["first"][i] <= c["last"][j]) & (p["last"][i] >= c["first"][j])
            else:
                one = (p["first"][i] == p["last"][i]) & (c["first"][j] == c["last"][j])
                fits = ~(one & (p["first"][i] == c["first"][j]))
            go = fits & (high >= node_need[i]) & (low <= node_most[i])
            i, j, low, high = i[go], j[go], low[go], high[go]
            a_leaf, c_leaf = a_left[i] < 0, c_left[j] < 0
            end = a_leaf & c_leaf
            leaves += zip(high[end], low[end], i[end].tolist(), j[end].tolist())
            wide = ~a_leaf & (c_leaf | (p["radius"][i] >= c["radius"][j]))  # the wider node is opened
            narrow = ~wide & ~end
            i, j = (
                np.concatenate([a_left[i[wide]], a_right[i[wide]], i[narrow], i[narrow]]),
                np.concatenate([j[wide], j[wide], c_left[j[narrow]], c_right[j[narrow]]]),
            )
        for high, _, i, j in sorted(leaves, reverse=True):
            s, e = w_start[i], w_stop[i]
            if high >= self.need[s:e].min():
                self._take(slice(s, e), _product(a.q[a_start[i] : a_stop[i]], q[ct.start[j] : ct.stop[j]]), int(a_start[i]), ids[ct.start[j] : ct.stop[j]], label[ct.start[j] : ct.stop[j]])

    def _take(self, windows: slice, s: np.ndarray, first: int, ids: np.ndarray, label: np.ndarray) -> None:
        a = self.a
        owner = a.owner[windows]
        alike = a.label[owner][:, None] == label[None, :]
        s = s[owner - first]
        ok = (s >= self.need[windows, None]) & (s <= a.high[windows, None])
        ok &= alike & (a.ids[owner][:, None] != ids[None, :]) if self.same else ~alike
        hit = np.flatnonzero(ok.any(1))
        if not len(hit):
            return
        s = np.where(ok[hit], s[hit], _NONE)
        order = np.argsort(-(s + 1), axis=1, kind="stable")[:, : self.k]  # a leaf is in order of ids
        at = hit + windows.start
        score = np.concatenate([self.score[at], np.take_along_axis(s, order, 1)], 1)
        id_ = np.concatenate([self.id[at], np.where(np.take_along_axis(s, order, 1) == _NONE, np.iinfo(np.int64).max, ids[order])], 1)
        score, id_ = _ordered(score, id_)
        again = (score[:, 1:] == score[:, :-1]) & (id_[:, 1:] == id_[:, :-1])  # a row met before
        score[:, 1:][again], id_[:, 1:][again] = _NONE, np.iinfo(np.int64).max
        score, id_ = _ordered(score, id_)
        self.score[at], self.id[at] = score[:, : self.k], id_[:, : self.k]
        self.need[at] = np.maximum(a.low[at], self.score[at, -1])

    def batches(self) -> Iterator[pa.RecordBatch]:
        window, place = np.nonzero(self.score != _NONE)
        out = pa.table({"anchor_id": self.a.ids[self.a.owner[window]], "key": self.a.key[window], "vec_id": self.id[window, place], "score": self.score[window, place]})
        yield from out.to_batches(65_536)


def _ordered(score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, axis=1, kind="stable")
    score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
    order = np.argsort(-(score + 1), axis=1, kind="stable")  # -(x + 1): the least integer has no negative of its own
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _matrix(q: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled with zeros, longer ones cut (what is beyond meets zeros)."""
    size = np.diff(q.offsets.to_numpy())
    flat = q.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(len(q), width).astype(np.int64)
    out = np.zeros((len(q), width), np.int64)
    row = np.repeat(np.arange(len(q)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = col < width
    out[row[keep], col[keep]] = flat[keep]
    return out


# ---- jobs ---------------------------------------------------------------------------------------------------------------


def _scan(rows: DataFrame, block: Anchors, same: bool, k: int) -> DataFrame:
    """(anchor_id, key, vec_id, score): the first k of each window of a block, rank by rank."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(sent.value, same, k), []
        width = sent.value.q.shape[1]

        def take() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            q = t["q"].combine_chunks()
            q = q.chunk(0) if isinstance(q, pa.ChunkedArray) else q
            ids, label, numbers = t["vec_id"].to_numpy(), t["label"].to_numpy(), _matrix(q, width)
            _, first = np.unique(np.column_stack([ids, label, numbers]), axis=0, return_index=True) if len(np.unique(ids)) < len(ids) else (None, slice(None))
            best.search(ids[first], label[first], numbers[first])
            held.clear()

        for b in batches:
            for at in range(0, b.num_rows, CHUNK_ROWS):
                held.append(b.slice(at, CHUNK_ROWS))
                if sum(x.num_rows for x in held) >= CHUNK_ROWS:
                    take()
        if held:
            take()
        yield from best.batches()

    found = rows.select("vec_id", "label", "q").mapInArrow(run, "anchor_id long, key long, vec_id long, score long").distinct()
    w = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _layout(rows: DataFrame) -> DataFrame:
    """rows with cell, the nearest pivot, in files by cell. Pivots are at most PIVOTS rows, the first by a hash of their ids."""
    pivots = [r.q for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("q").collect()]
    width = max((len(p) for p in pivots), default=0)
    centre = np.array([p + [0] * (width - len(p)) for p in pivots], np.float64).reshape(len(pivots), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("q"), width).astype(np.float64)
                near = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
                yield b.append_column("cell", pa.array(near.astype(np.int32)))

    dealt = rows.mapInArrow(run, "vec_id long, label long, q array<long>, cell int")
    return cut(dealt.repartitionByRange("cell", "vec_id").sortWithinPartitions("cell", "vec_id"))


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, label, q); is_anchor tells the anchors.

    percent: a negative's score in hundredths of the positive's, from and to.
    """
    spark = rows.sparkSession
    laid = _layout(rows.select("vec_id", "label", "q"))
    anchors = laid.where(is_anchor).groupBy("vec_id", "label", "q").agg(F.min("cell").alias("cell")).orderBy("cell", "vec_id", "label")
    out = new_table(spark)
    low, high = percent
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    append(spark.createDataFrame([], schema), out)
    for ids, label, q in _blocks(anchors):
        own = np.arange(len(ids))
        open_ = Anchors.of(ids, label, q, own, np.full(len(ids), _NONE), np.full(len(ids), np.iinfo(np.int64).max), own)
        near = _scan(laid, open_, True, n_positives).select("key", "vec_id", "score").toArrow()  # at most n_positives a row of the block
        owner, positive, score = (near[c].to_numpy() for c in ("key", "vec_id", "score"))
        least = -(-(low * score) // 100)
        most = (high * score) // 100
        some = least <= most
        owner, positive, score, least, most = owner[some], positive[some], score[some], least[some], most[some]
        window, key = np.unique(np.column_stack([owner, least, most]), axis=0, return_inverse=True) if len(owner) else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
        windows = Anchors.of(ids, label, q, window[:, 0], window[:, 1], window[:, 2], np.arange(len(window)))
        pairs = spark.createDataFrame(
            pa.table({"key": key.reshape(-1).astype(np.int64), "anchor_id": ids[owner], "positive_id": positive, "positive_score": score}),
            "key long, anchor_id long, positive_id long, positive_score long",
        )
        found = _scan(laid, windows, False, n_negatives).select("key", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
        append(pairs.join(found, "key").select(*[c.split()[0] for c in schema.split(", ")]), out)
    return spark.read.schema(schema).parquet(out)


def _blocks(anchors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors a block at a time: the driver holds one block."""
    held, numbers = [], 0
    for r in anchors.select("vec_id", "label", "q").toLocalIterator():
        held.append(r)
        numbers += len(r.q)
        if numbers >= BLOCK_NUMBERS:
            yield _arrays(held)
            held, numbers = [], 0
    if held:
        yield _arrays(held)


def _arrays(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(len(r.q) for r in held)
    q = np.array([list(r.q) + [0] * (width - len(r.q)) for r in held], np.int64).reshape(len(held), width)
    return np.array([r.vec_id for r in held]), np.array([r.label for r in held]), q
