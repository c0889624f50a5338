"""Spelling variants: a trie self-join with active-node sets, over a vocabulary partitioned by prefixes.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The vocabulary is a trie. A node's active
nodes are those within distance one of it; below a node and itself (distance zero) new ones arise where two children part (a code
point replaced) and where a child meets its own parent (one inserted), and a node at distance one stays active for as long as both go
on by the same code point, since no edit is left. Two words at which an active pair ends are near.

*   The trie is cut where a node has at most `most` words below it, in rounds that only the words of heavier nodes go on with: these
    nodes are the partitions. Inside them pairs are propagated by arrays, a bounded number of words at a time.
*   Pairs that part above a cut lie in two partitions. As their rest must be equal, they meet by a shuffle on what stands before the
    edit and what follows it. At most one word of each letter, and one without, has the same key, so no group grows with the data.

Each pair is found once, at the first code point in which its words differ. Nothing is capped: a heavy prefix gets deeper cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.session import ascii_lower, cut

#: The least depth of a cut; the words of a partition; the words whose trie is in memory at a time (the last partition may add to it).
FIRST, MOST_WORDS, CHUNK_WORDS = 3, 8192, 32_768
#: A form is used at least so many times as often as its variant.
RATIO = 10
_CHAR = 21  # bits of a code point


def letter_runs(text: Column, least: int) -> Column:
    """Maximal runs of at least so many Latin letters, A-Z lower-cased. Shorter runs can't give longer words."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})")), ascii_lower)


def vocabulary(words: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n) of a table (word): words of that length that occur so often. Nulls are no words."""
    counts = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least_count)


def partitions(vocab: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """vocab with prefix: the trie node, the highest from depth FIRST on with at most so many words, that the word is below."""
    left, done, depth = vocab, [], FIRST
    while True:
        keyed = left.withColumn("prefix", F.substring("word", 1, depth))
        heavy = cut(keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > most).select("prefix"))
        if heavy.isEmpty():
            return reduce(DataFrame.unionByName, [*done, keyed])
        done.append(keyed.join(heavy, "prefix", "left_anti"))
        left = cut(keyed.join(heavy, "prefix", "left_semi").drop("prefix"))
        depth = max(depth + 1, depth * 5 // 4)


def near_pairs(vocab: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, near, near_n): each pair of near words of vocab (word, n; each word once), in both orders."""
    parted = cut(partitions(vocab.select("word", "n"), most))
    inside = parted.repartition("prefix").sortWithinPartitions("prefix", "word").mapInArrow(_propagate, "word string, near string, near_n long")
    return inside.unionByName(_across(parted))


def _across(parted: DataFrame) -> DataFrame:
    """The pairs that part above a cut. Each word gives a row for each place above its own cut, with the code point there taken out,
    and a row for each with nothing taken out."""
    depth = F.char_length("prefix")
    row = parted.select("word", "n", F.explode(F.sequence(F.lit(0), depth)).alias("i"), depth.alias("_d"))
    before = F.substring("word", F.lit(1), F.col("i"))
    taken = F.struct(F.substring("word", F.col("i") + 1, F.lit(1)).alias("c"), F.substring("word", F.col("i") + 2, F.char_length("word")).alias("rest"))
    none = F.struct(F.lit(None).cast("string").alias("c"), F.substring("word", F.col("i") + 1, F.char_length("word")).alias("rest"))
    ways = F.when(F.col("i") < F.col("_d"), F.array(taken, none)).otherwise(F.array(none))
    rows = row.select("word", "n", before.alias("before"), F.explode(ways).alias("w")).select("word", "n", "before", "w.*")
    groups = rows.groupBy("before", "rest").agg(F.collect_list(F.struct("word", "n", "c")).alias("m")).where(F.size("m") > 1)
    pairs = groups.select("rest", F.explode("m").alias("x"), "m").select("rest", "x", F.explode("m").alias("y"))
    head = F.substring("rest", 1, 1)
    differ = lambda one: one.isNull() | (one != head)  # noqa: E731  (where one word has a letter more, it isn't the other's next letter)
    two = F.col("x.c").isNotNull() & F.col("y.c").isNotNull()
    one = F.col("x.c").isNull() != F.col("y.c").isNull()
    ok = (F.col("x.word") != F.col("y.word")) & (two | (one & differ(F.col("x.c")) & differ(F.col("y.c"))))
    return pairs.where(ok).select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def _propagate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs inside partitions: batches (word, n, prefix) in order of prefix and word."""
    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(t.num_rows for t in held) < CHUNK_WORDS:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        prefix = rows["prefix"].to_pylist()
        last = len(prefix) - 1
        while last > 0 and prefix[last - 1] == prefix[-1]:  # the last partition may go on in the next batch
            last -= 1
        if last:
            yield from _pairs_of(rows.slice(0, last))
        held = [rows.slice(last)]
    if held:
        yield from _pairs_of(pa.concat_tables(held).combine_chunks())


def _pairs_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    words = rows["word"].to_pylist()
    n = rows["n"].to_numpy()
    array = np.array(words, dtype=object)
    for a, b in active_pairs(words, rows["prefix"].to_pylist()):
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        for i in range(0, len(x), 65_536):
            j = slice(i, i + 65_536)
            yield pa.record_batch({"word": pa.array(array[x[j]], pa.string()), "near": pa.array(array[y[j]], pa.string()), "near_n": pa.array(n[y[j]], pa.int64())})


def _trie(words: list[str], prefixes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node of the tries below the prefixes: its parent (-1: a root), its code point, the word that ends there (-1: none).

    Words are in order, those of one prefix together. A node is made by the first word that goes through it.
    """
    parent, code, ends = [], [], []
    path: list[int] = []  # nodes of the word before, from its root on
    old, old_prefix = "", None
    for i, (word, prefix) in enumerate(zip(words, prefixes)):
        at = len(prefix)
        if prefix != old_prefix:
            parent.append(-1)
            code.append(0)
            ends.append(-1)
            path, shared = [len(parent) - 1], at
        else:
            shared, most = at, min(len(word), len(old))
            while shared < most and word[shared] == old[shared]:
                shared += 1
            del path[shared - at + 1 :]
        for c in word[shared:]:
            parent.append(path[-1])
            code.append(ord(c))
            ends.append(-1)
            path.append(len(parent) - 1)
        ends[path[-1]] = i
        old, old_prefix = word, prefix
    return np.array(parent, np.int64), np.array(code, np.int64), np.array(ends, np.int64)


def active_pairs(words: list[str], prefixes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near words that part below their common prefix, each pair once: active pairs of nodes go down level by level."""
    parent, code, ends = _trie(words, prefixes)
    key = (parent << _CHAR) | code
    child = np.argsort(key, kind="stable")
    child = child[parent[child] >= 0]  # roots have no parent
    key = key[child]
    first = np.searchsorted(key, np.arange(len(parent), dtype=np.int64) << _CHAR)
    stop = np.append(first[1:], len(key))
    # two children of a node: the code point is replaced
    later = stop[parent[child]] - np.arange(len(child)) - 1
    u = np.repeat(child, later)
    v = child[np.arange(len(u)) - np.repeat(np.cumsum(later) - later, later) + np.repeat(np.arange(len(child)) + 1, later)]
    # a child and its parent: the code point is inserted, and isn't the next one of the other word
    u, v = np.concatenate([u, child]), np.concatenate([v, parent[child]])
    bar = np.concatenate([np.full(len(u) - len(child), -1), code[child]])
    while len(u):
        both = (ends[u] >= 0) & (ends[v] >= 0)
        if both.any():
            yield ends[u[both]], ends[v[both]]
        many = stop[u] - first[u]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[u], many)
        below, other, bar = child[place], np.repeat(v, many), np.repeat(bar, many)
        want = (other << _CHAR) | code[below]
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        go = (key[at] == want) & (code[below] != bar) if len(key) else np.zeros(0, bool)
        u, v, bar = below[go], child[at[go]], np.full(go.sum(), -1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form; each word once) lead to. A form is RATIO times as frequent as its variant, so there
    are no cycles and chains are short; each round doubles the steps taken."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return now


def variants(vocab: DataFrame, ratio: int = RATIO, most: int = MOST_WORDS) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for each row of vocab (word, n; each word once).

    form is the near word of the largest n, ties to the smallest in code-point order, if it occurs at least `ratio` times as often;
    root is where forms lead to, the word itself without one. An empty vocabulary gives no rows; a word may be of any length.
    """
    vocab = cut(vocab.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))).alias("b")
    near = near_pairs(vocab, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    has = -F.col("b.k") >= ratio * F.col("n")
    out = vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.k")).alias("form_n")
    )
    out = cut(out)
    end = roots(out.where(F.col("form").isNotNull()))
    return out.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(docs: DataFrame, least_length: int = 7, every: int | None = 31) -> DataFrame:
    """(word): all words of whole texts (doc_id, text) that can be `least_length` long, once for each occurrence. A null text has none.

    every: of a document's word whose crc32 of "<doc_id>:<word>" it divides, one code point is left out, the one at that crc32 modulo
    the word's length: planted misspellings. None leaves words as they are, as does a null doc_id.
    """
    run = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(letter_runs(F.col("text"), least_length)).alias("w"))
    if every is None:
        return run.select(F.col("w").alias("word"))
    run = run.select("w", F.crc32(F.concat("d", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    less = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.char_length("w")))
    return run.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word"))
