"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; each path from a root to a node is a rule, a conjunction of
comparisons. A logistic model with an L1 penalty weighs the rules and sets most of the weights to zero; what is left is compiled
into one Spark column expression over the statistics, so scoring a row is a sum of a few comparisons. The statistics are made
from whole texts by vectorised kernels, a batch at a time; nothing is shuffled but the sample.

Cases: a null or empty text has all statistics 0 and gets a score like any other; labels that are null are left out, a document
with several labels counts as their majority (ties as 1); without labels every score is 0.5, with one class alone the model is
its smoothed share; repeated rows score alike and are learned from once; very long texts are taken whole; an empty table gives an
empty result; columns named like a result are replaced by `classify` and kept by `keep_good`, as all other columns are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.text_kernels import SPACED, Words, slices, windows

#: Labelled rows the model is fitted on at most: those with the least hash of their id.
MAX_SAMPLE = 12_000
TREES, DEPTH, CUTS, LEAST_ROWS = 24, 3, 24, 20
PENALTIES = (0.02, 0.006, 0.002)

_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "pipe": (124,),
    "bang": (33,),
    "symbol": tuple(b"#*$%&<>@^~=_\\/{}[]+"),
    "stop": tuple(b".,;:?"),
    "line": (10,),
}
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate(_CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _k
STATISTICS = ("words", "word_bytes", *(f"{c}_share" for c in _CLASSES), "distinct_share", "echo_share", "repeat_share")


def statistics_of(w: Words) -> np.ndarray:
    """rows x STATISTICS of a slice of texts."""
    n = len(w.at) - 1
    size = np.diff(w.at)
    by_class = np.bincount(np.repeat(np.arange(n), size) * (len(_CLASSES) + 1) + _CLASS[w.raw], minlength=n * (len(_CLASSES) + 1))
    by_class = by_class.reshape(n, -1)[:, 1:] / np.maximum(size, 1)[:, None]
    words, row = w.counts, w.row
    some = np.maximum(words, 1)
    length = np.bincount(row, weights=w.end - w.start, minlength=n) / some

    def different(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, rows))
        r, v = rows[order], values[order]
        new = np.ones(len(v), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        return np.bincount(r[new], minlength=n)

    echo = np.zeros(n)
    if len(row) > 1:
        same = (row[1:] == row[:-1]) & (w.hash[1:] == w.hash[:-1])
        echo = np.bincount(row[1:][same], minlength=n) / some
    at, g = windows(w, 4)
    grams = np.bincount(row[at], minlength=n)
    repeat = (grams - different(row[at], g)) / np.maximum(grams, 1)
    # Of the first words only one in many can be new in a long text: the share is taken against the square root.
    distinct = different(row, w.hash) / np.sqrt(some)
    return np.column_stack([words, length, by_class, distinct, echo, repeat]).astype(np.float64)


def with_statistics(docs: DataFrame, keep: list[str], prefix: str, text: str = "text") -> DataFrame:
    """The columns `keep` of docs and the statistics of the text as doubles named prefix + statistic."""
    sent = keep if text in keep else [text, *keep]
    at, places = sent.index(text), [sent.index(c) for c in keep]
    names = [*keep, *(prefix + c for c in STATISTICS)]
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField(prefix + c, T.DoubleType()) for c in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(at).cast(pa.string()), SPACED):
                stats = statistics_of(w)
                cols = [b.column(c).slice(i, j - i) for c in places] + [pa.array(np.ascontiguousarray(x)) for x in stats.T]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, out)


def free_prefix(docs: DataFrame) -> str:
    """A beginning that no column's name has."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


#: (statistic, whether above, cut): one comparison of a rule.
Test = tuple[int, bool, float]


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[tuple[Test, ...], float]] = field(default_factory=list)

    def score(self, prefix: str) -> Column:
        """The probability of label 1, over the columns of the statistics."""
        total = F.lit(float(self.intercept))
        for tests, weight in self.rules:
            said = reduce(lambda a, b: a & b, (_said(t, prefix) for t in tests))
            total = total + F.when(said, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _said(t: Test, prefix: str) -> Column:
    c = F.col(f"`{prefix}{STATISTICS[t[0]]}`")
    return c > F.lit(t[2]) if t[1] else c <= F.lit(t[2])


def _tree_rules(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray) -> tuple[list[tuple[Test, ...]], np.ndarray]:
    """Paths of one least-squares tree on the gradient, and its prediction."""
    rules: list[tuple[Test, ...]] = []
    out = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple[Test, ...]) -> None:
        g = grad[rows]
        out[rows] = g.mean()
        if len(path) == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return
        best, total = (1e-9, -1, -1), g.sum()
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            n = np.cumsum(np.bincount(bins[rows, f], minlength=len(c) + 1))[:-1]
            s = np.cumsum(np.bincount(bins[rows, f], weights=g, minlength=len(c) + 1))[:-1]
            m = len(rows) - n
            ok = (n >= LEAST_ROWS) & (m >= LEAST_ROWS)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(m, 1) - total**2 / len(rows), 0)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        _, f, k = best
        if f < 0:
            return
        above = bins[rows, f] > k
        for side in (False, True):
            step = (*path, (f, side, float(cuts[f][k])))
            rules.append(step)
            grow(rows[above == side], step)

    grow(np.arange(len(grad)), ())
    return rules, out


def _holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, cut_ in tests:
        out &= (x[:, f] > cut_) if above else (x[:, f] <= cut_)
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for mean log loss + penalty * |w|; the intercept is free."""
    n = len(y)
    rate = 4.0 / (1.0 + np.linalg.norm(a, axis=0).max() ** 2 / n * min(a.shape[1], 30))
    w, b = np.zeros(a.shape[1]), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(a @ v + c))) - y
        new = v - rate * (a.T @ err) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, new_t = c - rate * err.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return b, w


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighed by lasso; the penalty is the one that does best on every fifth row."""
    if not len(y):
        return RuleModel()
    share = (y.sum() + 1) / (len(y) + 2)
    model = RuleModel(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2 or len(y) < 4 * LEAST_ROWS:
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    raw, rules = np.full(len(y), model.intercept), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        found, step = _tree_rules(bins, cuts, y - p)
        rules.update(dict.fromkeys(found))
        raw = raw + step / max(1e-3, float((p * (1 - p)).mean()))  # a Newton step of the mean curvature
        raw = np.clip(raw, -6, 6)
    paths, seen = [], set()
    for r in rules:
        held = _holds(x, r)
        if (mark := held.tobytes()) not in seen and LEAST_ROWS <= held.sum() <= len(y) - LEAST_ROWS:
            seen.add(mark)
            paths.append((r, held))
    if not paths:
        return model
    a = np.column_stack([h for _, h in paths]).astype(np.float64)
    test = np.arange(len(y)) % 5 == 0

    def loss(penalty: float) -> float:
        b, w = _lasso(a[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[test] @ w + b))), 1e-6, 1 - 1e-6)
        return float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean())

    b, w = _lasso(a, y, min(PENALTIES, key=loss))
    return RuleModel(b, [(paths[k][0], float(w[k])) for k in np.flatnonzero(np.abs(w) > 1e-6)])


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_i")).agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    sample = known.orderBy(F.xxhash64("_i"), "_i").limit(MAX_SAMPLE)  # two numbers a row: small enough to broadcast by its limit
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = texts.join(F.broadcast(sample), F.col("_id") == F.col("_i")).select("_i", "_y", "_text")
    names = [f"s_{c}" for c in STATISTICS]
    # An id may have any number of rows: different ones count once, and MAX_SAMPLE of them at most reach the driver.
    different = with_statistics(rows, ["_i", "_y"], "s_", "_text").distinct()
    got = different.orderBy(F.xxhash64("_i"), "_i", *names).limit(MAX_SAMPLE).toPandas().sort_values(["_i", *names])
    return fit(got[names].to_numpy(float), got["_y"].to_numpy(float))


def classify(docs: DataFrame, model: RuleModel, keep: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns `keep` of docs with held_out, score and predicted (1 from a score of 0.5 on)."""
    made, prefix = ("held_out", "score", "predicted"), free_prefix(docs)
    keep = [c for c in keep if c.lower() not in made]
    sent = keep if doc_id in keep else [*keep, doc_id]
    out = with_statistics(docs, sent, prefix, text).withColumn("held_out", held_out(F.col(doc_id))).withColumn("score", model.score(prefix))
    return out.select(*[F.col(f"`{c}`") for c in keep], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """docs without the rows whose score is under 0.5; all columns, of any name, stay as they are."""
    prefix = free_prefix(docs)
    good = with_statistics(docs, docs.columns, prefix, text).where(model.score(prefix) >= 0.5)
    return good.select(*[F.col(f"`{c}`") for c in docs.columns])
