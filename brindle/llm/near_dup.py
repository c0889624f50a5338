"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document is the set of its word shingles. Its sketch has COORDINATES bins: in round i every element is dealt to a bin by a hash
of the round, and an empty bin takes the smallest value it gets, values of earlier rounds being smaller than those of later
ones; after COORDINATES rounds, round COORDINATES + j puts every element into bin j, so each bin is filled. Two sketches agree in
a bin with the sets' similarity as probability, and the number of agreeing bins is as concentrated as with independent hashes.

1.  One pass over the texts makes each row's sketch and its set's 128-bit digest. Rows of one digest are one set from here on,
    under a number of its own.
2.  BANDS bands of ROWS bins: sets that agree in a band share a bucket. In each bucket the sets are paired with its pivot only,
    the set with the least number, and pairs whose sizes or sketches rule the threshold out go. Families are the components of
    what is left.
3.  Buckets that hold several families are compared across these by sketch, block against block.
4.  The texts of all sets in a pair are read once more and move once; every pair is verified on its full sets, at its pivot's.
5.  Pairs that no pivot has settled are now inside families. One that isn't yet one component is compared block against block,
    first by sketch, and where a set has a likely partner in another component on the full sets: a product over the blocks'
    shingles gives all intersections, and only a spanning tree of the links leaves the task. A family of copies that is one
    component already costs nothing.
6.  Components of the verified links; a row's component is the smallest id in it.

Blocks hold about BLOCK sets and BLOCK_SHINGLES shingles at most (a larger set is one by itself), of one class of sizes, and meet
only blocks of the classes that can reach the similarity. So no bucket is capped, no group is ever in one task, and no list of all
pairs is made. What remains square is a family in which very many sets are likely partners and few are linked.

At the threshold 0.85 a link shares no bucket with probability (1 - 0.85^4)^32 = 6e-11, and the sketch filter (SLACK standard
deviations below the threshold) drops one with probability below 1e-8; links are never made without the full sets.

Cases: a null text, or one without words, has an empty set, no links and itself as component; fewer words than a shingle are one
shingle; a null id takes part, and its component is the smallest id of its group, null if there is none; repeated rows are
equal sets; very long texts are taken whole; an empty table gives an empty result; other columns, of any name, pass `keep_first`
unchanged and don't enter `near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.session import cut, hidden
from brindle.llm.text_kernels import SPACED, Words, mix, slices, windows

ROWS, BANDS = 4, 32
COORDINATES = ROWS * BANDS
SLACK = 6.0
#: Sets of a block, and their shingles together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
_U = np.uint64
_ROUNDS = np.random.default_rng(7).integers(0, 2**64, 2 * COORDINATES, dtype=np.uint64)
_FULL = _U(2**64 - 1)


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each different shingle, sorted by both. A row of fewer words than k has their whole sequence."""
    at, g = windows(w, k)
    rows, hashes = [w.row[at]], [g]
    for n in range(1, k):
        short = np.flatnonzero(w.counts == n)
        if len(short):
            at, g = windows(w, n)
            own = np.isin(w.row[at], short)
            rows.append(w.row[at][own])
            hashes.append(g[own])
    row, g = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((g, row))
    row, g = row[order], g[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (g[1:] != g[:-1])
    return row[new], g[new]


def sketches(row: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """n x COORDINATES values of 16 bits of the n rows' sets; rows without elements keep zeros."""
    t = COORDINATES
    out = np.full((n, t), _FULL)
    left_row, left = row, g
    for i in range(2 * t):
        if not len(left):
            break
        h = mix(left ^ _ROUNDS[i])
        bin_ = (h & _U(t - 1)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out.reshape(-1), left_row * t + bin_, (_U(i) << _U(48)) | (h >> _U(16)))
        open_ = (out == _FULL).any(axis=1)[left_row]
        left_row, left = left_row[open_], left[open_]
    done = (mix(out) & _U(0xFFFF)).astype(np.uint16)
    done[np.bincount(row, minlength=n) == 0] = 0
    return done


def _digests(row: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and two 64-bit digests of the rows' sets."""
    size = np.bincount(row, minlength=n)
    ends = np.cumsum(size)
    both = []
    for seed in (_U(0x1234567), _U(0x7654321)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g ^ seed), dtype=np.uint64)])
        both.append(mix(total[ends] - total[ends - size] + size.astype(np.uint64)))
    return size, both[0], both[1]


def _row_key(id_: Column, one: Column, two: Column) -> Column:
    """Never null, and equal for rows of equal id and text: the id (null as itself) and two hashes of the text."""
    return F.concat_ws(":", F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit("null")), F.hex(one), F.hex(two))


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def sketch_table(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(id, h, h2, n, d, d2, bands array<bigint>): of each row the text's hashes, set size, digest and sketch, ROWS bins to a long."""
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(3), SPACED):
                row, g = shingle_sets(w, k)
                size, one, two = _digests(row, g, j - i)
                flat = sketches(row, g, j - i).view(np.int64).reshape(-1)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
                cols = [*(b.column(c).slice(i, j - i) for c in range(3)), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h", "h2", "n", "d", "d2", "bands"])

    body = F.col(text).cast("string")
    one, two = _text_hashes(body)
    rows = docs.select(F.col(doc_id).alias("id"), one.alias("h"), two.alias("h2"), body.alias("text"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, h bigint, h2 bigint, n bigint, d bigint, d2 bigint, bands array<bigint>")


def _size_class(n: Column, percent: int) -> Column:
    """Sets can reach the similarity only within one class or two neighbouring ones."""
    return (F.floor(F.log(n) / math.log(100 / percent)) if percent < 100 else n).cast("int")


def _least_agreeing(percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(COORDINATES * p - SLACK * math.sqrt(COORDINATES * p * (1 - p))))


def _agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For all rows of a and b (16-bit bins), in how many they agree; a stripe at a time."""
    out = np.empty((len(a), len(b)), dtype=np.int32)
    for i in range(0, len(a), 32):
        out[i : i + 32] = (a[i : i + 32, None, :] == b[None, :, :]).sum(axis=2)
    return out


def _bins(bands: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(bands, pa.Array):
        flat = bands.flatten().to_numpy(zero_copy_only=False)
    else:
        flat = np.concatenate(list(bands)) if len(bands) else np.zeros(0, np.int64)
    return flat.astype(np.int64).view(np.uint16).reshape(-1, COORDINATES)


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, p) whose sizes and sketches don't rule the similarity out."""
    least = _least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = (_bins(b.column(2)) == _bins(b.column(3))).sum(axis=1)
            yield b.select([0, 1]).filter(pa.array(same >= least))

    left, right = sets.select("g", "n", F.col("bands").alias("x")), sets.select(F.col("g").alias("p"), F.col("n").alias("m"), F.col("bands").alias("y"))
    found = pairs.join(left, "g").join(right, "p").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return cut(found.select("g", "p", "x", "y").mapInArrow(run, "g bigint, p bigint"))


def _full_sets(pairs: DataFrame, sets: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(g, groups, items): the full sorted set of each end of a pair, and the groups (p, s) in which it is verified.

    A group is a pivot and a bounded part of its partners. The texts are joined by row, so each needed one moves once.
    """
    pivots = pairs.join(sets.select("g", "n"), "g").groupBy("p").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("k"))
    pivots = cut(pivots)
    parts = pairs.join(pivots, "p").select("g", "p", F.pmod(F.xxhash64("g"), "k").cast("int").alias("s"))
    own = pivots.select(F.col("p").alias("g"), "p", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("s"))
    groups = parts.unionByName(own).groupBy("g").agg(F.collect_list(F.struct("p", "s")).alias("groups"))
    needed = groups.join(sets.select("g", "id", "h", "h2"), "g").select(_row_key(F.col("id"), F.col("h"), F.col("h2")).alias("key"), "g", "groups")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(2), SPACED):
                row, g = shingle_sets(w, k)
                ends = np.searchsorted(row, np.arange(1, j - i + 1)).tolist()
                items = [g[a:z].tobytes() for a, z in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(items, pa.binary())], ["g", "groups", "items"])

    body = F.col(text).cast("string")
    rows = docs.select(_row_key(F.col(doc_id), *_text_hashes(body)).alias("key"), body.alias("text")).join(needed, "key")
    once = rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("g", "groups", "text")]).drop("key")  # rows equal in id and text
    return cut(once.mapInArrow(run, "g bigint, groups array<struct<p: bigint, s: int>>, items binary"))


def _verified(full: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of pivots and partners with 100 * intersection >= percent * union on the full sets."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        p = group["p"].iloc[0]
        sets = {g: np.frombuffer(x, np.uint64) for g, x in zip(group["g"], group["items"])}
        hub, linked = sets.pop(p), []
        for g, x in sets.items():
            both = np.count_nonzero(hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x)
            if 100 * both >= percent * (len(hub) + len(x) - both):
                linked.append(g)
        return pd.DataFrame({"a": linked, "b": p}, dtype="int64")

    rows = full.select("g", "items", F.explode("groups").alias("q")).select("q.p", "q.s", "g", "items")
    return cut(rows.groupBy("p", "s").applyInPandas(compare, "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(g, c): for each end of a link (a, b) the smallest end that it reaches, by least labels and jumps over them."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    label = cut(edges.groupBy(F.col("a").alias("g")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        near = edges.join(label.select(F.col("g").alias("b"), F.col("c").alias("d")), "b").groupBy(F.col("a").alias("g")).agg(F.min("d").alias("d"))
        step = cut(label.join(near, "g").select("g", F.least("c", "d").alias("c"), F.col("c").alias("was")))
        jump = step.select(F.col("g").alias("c"), F.col("c").alias("e"))
        new = cut(step.join(jump, "c", "left").select("g", F.least("c", F.coalesce("e", "c")).alias("c"), "was"))
        label = new.select("g", "c")
        if not new.where("c <> was").limit(1).count():
            return label


def _shared_buckets(sets: DataFrame) -> DataFrame:
    """(g, p, q): each set in each bucket q that it shares with others, with the bucket's pivot p, the least set in it."""
    rows = sets.select("g", F.posexplode("bands").alias("pos", "band")).select("g", F.xxhash64("pos", "band").alias("q"))
    pivots = rows.groupBy("q").agg(F.min("g").alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    return cut(rows.join(pivots, "q").select("g", "p", "q"))


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members (s, g, n, c) of the groups s in blocks, each where it meets another: (s, x, y, side, g, n, c).

    Large components c have blocks of their own, which don't meet each other; the rest share some, a component in one. Blocks of a
    group meet if their classes of sizes are the same or neighbours; x = y is a block's meeting with itself, on side 0.
    """
    rows = members.withColumn("z", _size_class(F.col("n"), percent))
    parts = rows.groupBy("s", "z", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    blocks_of = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("w") / BLOCK_SHINGLES)).cast("int")
    parts = cut(parts.withColumn("k", blocks_of))
    rest = parts.where("k = 1").groupBy("s", "z").agg(F.sum("m").alias("m"), F.sum("w").alias("w")).select("s", "z", blocks_of.alias("r"))
    own = parts.join(rest, ["s", "z"], "left").select("s", "z", "c", "k", F.coalesce("r", F.lit(1)).alias("r"))
    apart = F.col("k") > 1
    block = F.when(apart, F.concat_ws(":", "z", "c", F.pmod(F.xxhash64("g"), "k"))).otherwise(F.concat_ws(":", "z", F.lit("m"), F.pmod(F.xxhash64("c"), "r")))
    placed = cut(rows.join(own, ["s", "z", "c"]).select("s", "z", "g", "n", "c", block.alias("block"), F.when(apart, F.col("c")).alias("pure")))
    blocks = placed.groupBy("s", "z", "block").agg(F.first("pure").alias("pure"))  # a row for some BLOCK sets
    x = blocks.select("s", "z", F.col("block").alias("x"), F.col("pure").alias("px"))
    y = blocks.select("s", F.explode(F.array(F.col("z"), F.col("z") - 1)).alias("z"), F.col("z").alias("zy"), F.col("block").alias("y"), F.col("pure").alias("py"))
    met = cut(x.join(y, ["s", "z"]).where("(z < zy or x <= y) and not (px is not null and px <=> py)").select("s", "x", "y"))
    left = placed.join(met.withColumn("block", F.col("x")), ["s", "block"]).withColumn("side", F.lit(0))
    right = placed.join(met.where("x <> y").withColumn("block", F.col("y")), ["s", "block"]).withColumn("side", F.lit(1))
    return left.unionByName(right).select("s", "x", "y", "side", "g", "n", "c")


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    first = group["side"].to_numpy() == 0
    a = group[first]
    return a, a if group["x"].iloc[0] == group["y"].iloc[0] else group[~first]


def _likely_between(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> np.ndarray:
    """Of all sets of a with all of b, of different components, whom sizes and sketches don't rule out."""
    same = _agreeing(_bins(a["bands"]), _bins(b["bands"])) >= _least_agreeing(percent)
    na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
    return same & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :])


def _across_pairs(shared: DataFrame, sets: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """(g, p): likely pairs of one bucket in different families, none of them the bucket's pivot."""
    known = shared.join(family, "g", "left").withColumn("c", F.coalesce("c", "g"))
    open_ = known.groupBy("q").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("m > 2 and c0 <> c1").select("q")
    inside = known.where("g <> p").join(open_, "q").join(sets.select("g", "n"), "g").select(F.col("q").alias("s"), "g", "n", "c")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(group)
        i, j = np.nonzero(_likely_between(a, b, percent))
        g, p = a["g"].to_numpy()[i], b["g"].to_numpy()[j]
        return pd.DataFrame({"g": np.maximum(g, p), "p": np.minimum(g, p)}).drop_duplicates()

    rows = _block_pairs(cut(inside), percent).join(sets.select("g", "bands"), "g")
    return cut(rows.groupBy("s", "x", "y").applyInPandas(compare, "g bigint, p bigint").distinct())


def _family_links(sets: DataFrame, family: DataFrame, label: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning tree of the links inside each family (g, c) that isn't one component yet."""
    own = family.select("g", F.col("c").alias("s")).join(label, "g", "left").withColumn("c", F.coalesce("c", "g"))
    open_ = own.groupBy("s").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("s")
    members = cut(own.join(open_, "s").join(sets.select("g", "n"), "g").select("s", "g", "n", "c"))

    def narrow(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _sides(group)
        likely = _likely_between(a, b, percent)
        out = [a[likely.any(axis=1)], b[likely.any(axis=0)]]
        return pd.concat(out if a is not b else [a[likely.any(axis=1) | likely.any(axis=0)]])[["s", "x", "y", "side", "g", "c"]]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _spanning(*_sides(group), percent)

    rows = _block_pairs(members, percent).join(sets.select("g", "bands"), "g")
    rows = cut(rows.groupBy("s", "x", "y").applyInPandas(narrow, "s bigint, x string, y string, side int, g bigint, c bigint"))
    return cut(rows.join(full.select("g", "items"), "g").groupBy("s", "x", "y").applyInPandas(compare, "a bigint, b bigint"))


#: Different shingles that enter one matrix product.
_COLUMNS = 4096


def _intersections(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products over the shingles that occur on both sides."""
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    fa, fb = np.concatenate([*a, np.zeros(0, np.uint64)]), np.concatenate([*b, np.zeros(0, np.uint64)])
    both = np.intersect1d(fa, fb)
    ra, rb = np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)
    ca, cb = np.searchsorted(both, fa), np.searchsorted(both, fb)
    ia, ib = (c < len(both) for c in (ca, cb))
    ia[ia] = both[ca[ia]] == fa[ia]
    ib[ib] = both[cb[ib]] == fb[ib]
    ra, ca, rb, cb = ra[ia], ca[ia], rb[ib], cb[ib]
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(both), _COLUMNS):
        m, n = np.zeros((len(a), _COLUMNS), np.float32), np.zeros((len(b), _COLUMNS), np.float32)
        for mat, r, c in ((m, ra, ca), (n, rb, cb)):
            own = (c >= at) & (c < at + _COLUMNS)
            mat[r[own], c[own] - at] = 1
        out += m @ n.T
    return out


def _spanning(a: pd.DataFrame, b: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (a, b) that connect what links between the sets of a and those of b, of different components, connect."""
    if not len(a) or not len(b):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    sa, sb = ([np.frombuffer(x, np.uint64) for x in f["items"]] for f in (a, b))
    both = _intersections(sa, sb).astype(np.int64)
    na, nb = np.array([len(x) for x in sa])[:, None], np.array([len(x) for x in sb])[None, :]
    linked = (100 * both >= percent * (na + nb - both)) & (a["c"].to_numpy()[:, None] != b["c"].to_numpy()[None, :])
    ga, gb = a["g"].to_numpy(), b["g"].to_numpy()
    top = np.iinfo(np.int64).max
    la, lb = ga.copy(), gb.copy()
    while True:  # least labels over the links, each step a row of minima
        na_ = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1))
        nb_ = np.minimum(lb, np.where(linked, na_[:, None], top).min(axis=0))
        if (na_ == la).all() and (nb_ == lb).all():
            break
        la, lb = na_, nb_
    g, l = np.concatenate([ga, gb]), np.concatenate([la, lb])
    own = g != l
    return pd.DataFrame({"a": l[own], "b": g[own]}).drop_duplicates()


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and for each set (d, d2) the smallest row of its component: its id, h and h2."""
    rows = cut(sketch_table(docs, doc_id, text, shingle))
    # The set's first row: ids before null.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2")).alias("r")
    sets = rows.where("n > 0").groupBy("d", "d2").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("g"), "d", "d2", "r.id", "r.h", "r.h2", "n", "bands"))
    shared = _shared_buckets(sets)
    likely = _likely(shared.where("g <> p").select("g", "p").distinct(), sets, percent)
    family = components(likely.select(F.col("g").alias("a"), F.col("p").alias("b")))
    across = _across_pairs(shared, sets, family, percent)
    full = _full_sets(likely.unionByName(across), sets, docs, doc_id, text, shingle)
    links = _verified(full, percent)
    label = components(links)
    inside = _family_links(sets, family, label, full, percent)
    if inside.limit(1).count():
        label = components(links.unionByName(inside))
    named = sets.select("g", "d", "d2", F.struct(F.col("id").isNull().alias("none"), "id", "h", "h2").alias("r")).join(label, "g", "left").withColumn("c", F.coalesce("c", "g"))
    return rows, named.join(named.groupBy("c").agg(F.min("r").alias("least")), "c").select("d", "d2", "least")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each of docs; sets are linked from percent / 100 similarity on."""
    rows, least = _grouped(docs, doc_id, text, shingle, percent)
    out = rows.select("id", "n", "d", "d2").join(least, ["d", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False)))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group, that of the smallest id (null last), and of rows equal in id and text one.

    Decisions are made by row, not by id: another text under the id of a removed one stays if its own group's first is it.
    """
    rows, least = _grouped(docs, doc_id, text, shingle, percent)
    later = ~(F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h")) & (F.col("h2") == F.col("least.h2")))
    key, copy = hidden(docs, "_key", "_copy")
    gone = rows.where("n > 0").select("id", "h", "h2", "d", "d2").join(least, ["d", "d2"]).where(later)
    gone = gone.select(_row_key(F.col("id"), F.col("h"), F.col("h2")).alias(key)).distinct()
    keyed = docs.withColumn(key, _row_key(F.col(doc_id), *_text_hashes(F.col(text).cast("string"))))
    # The first of a key is told in each task before anything moves, so repeated rows don't meet in one.
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*plain)))
    left = keyed.withColumn(copy, first).where(F.col(copy) == 1)
    return left.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
