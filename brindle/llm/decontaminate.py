"""Benchmark decontamination by winnowing.

Both sides are hashed in k-grams of words, and of every span of SPAN consecutive words the least k-gram hash is kept as its
fingerprint, so two equal spans always share theirs: no shared span of SPAN words is missed. Where a document's fingerprint is one
of the benchmark's, the match is extended to the whole span around it, by the span's hash and then word for word, so nothing is
reported that isn't there. An item of fewer words than SPAN is one span of its own length, with k and the window to suit.

The benchmark goes to the workers as a broadcast of at most BLOCK_BYTES of text, in sorted arrays that take some ten times that.
A larger one is taken in blocks, a pass over the documents for each that writes the hits alone; these are added up by
text. Within a pass documents aren't shuffled, and a document is judged whole.

Cases: a null text has no words and no hits; null or empty texts of items have no windows; a null item id is an item like others, a
null at the end of `items`, which the digest of the ids leaves out; equal windows of several items count for each of them; equal
items (rows of one id) count once; repeated documents are judged alike, one row each; overlapping hits count a word once; very long
texts are taken whole; an empty benchmark hits nothing, an empty table gives an empty result; columns named like a result are
replaced by `decontaminate` and kept by `keep_clean`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.session import ascii_lower, cut, free_name, hidden
from brindle.llm.text_kernels import ALNUM, Words, slices, windows

SPAN = 10
#: UTF-8 bytes of benchmark text that are broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Places of an index's filter before its sorted fingerprints, at least and at most.
_FILTER = (1 << 16, 1 << 24)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _ordered(ids: set[str | None]) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i))


def _gram(span: int) -> int:
    """Words of a k-gram, so that a span holds several."""
    return (span + 1) // 2


def _fingerprints(w: Words, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each span inside a row and the least hash of its k-grams."""
    k = _gram(span)
    at, g = windows(w, k)
    r = span - k + 1  # k-grams of a span
    n = len(g) - r + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, r):
        np.minimum(least, g[j : n + j], out=least)
    row = w.row
    own = row[at[:n]] == row[at[r - 1 :]]
    return at[:n][own], least[own]


@dataclass
class Windows:
    """The different windows of one length, sorted by hash, with their place in the text and the items that hold them."""

    prints: np.ndarray  # fingerprints, sorted
    maybe: np.ndarray  # whether a fingerprint with these low bits is there
    hash: np.ndarray
    word: np.ndarray  # the window's first word
    first: np.ndarray  # of each window's items, and one more
    item: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.prints, self.maybe, self.hash, self.word, self.first, self.item))


class Index:
    """Windows of benchmark items by length, over one text of all their words joined by single spaces."""

    def __init__(self, items: list[tuple[str | None, str]], span: int):
        self.names = [i for i, _ in items]
        blob, ends, base = [], [np.zeros(1, np.int64)], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)
        for i, _, w in slices(pa.array([t for _, t in items], pa.string()), ALNUM):
            row, own = w.row, np.minimum(w.counts, span)
            for length in np.unique(own[own > 0]).tolist():
                at, least = _fingerprints(w, length)
                _, h = windows(w, length)  # at the same places
                mine = own[row[at]] == length
                found[length].append((least[mine], h[mine], at[mine] + base, row[at[mine]] + i))
            if len(w.start):
                blob.append(w.text(0, len(w.start)) + b" ")
                ends.append(ends[-1][-1] + np.cumsum(w.end - w.start + 1))
                base += len(w.start)
        self.blob, self.at = b"".join(blob), np.concatenate(ends)
        self.lengths = {length: self._windows(length, *(np.concatenate(x) for x in zip(*parts))) for length, parts in found.items()}

    def _windows(self, length: int, prints: np.ndarray, h: np.ndarray, word: np.ndarray, item: np.ndarray) -> Windows:
        prints = np.unique(prints)
        bits = min(max(1 << (8 * len(prints)).bit_length(), _FILTER[0]), _FILTER[1])
        maybe = np.zeros(bits, dtype=bool)
        maybe[(prints & np.uint64(bits - 1)).astype(np.int64)] = True
        order = np.argsort(h, kind="stable")
        h, word, item = h[order], word[order], item[order].astype(np.int32)
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(h))
        if (ends - starts == 1).all():
            return Windows(prints, maybe, h, word.astype(np.int32), np.arange(len(h) + 1, dtype=np.int32), item)
        # Windows that occur more than once: the items of each different text, of which nearly always one has the hash.
        hs, words_, firsts, items = [], [], [0], []
        for a, z in zip(starts.tolist(), ends.tolist()):
            texts: dict[bytes, tuple[int, set[int]]] = {}
            for k in range(a, z):
                texts.setdefault(self.text(int(word[k]), length), (int(word[k]), set()))[1].add(int(item[k]))
            for place, own in texts.values():
                hs.append(a)
                words_.append(place)
                items += sorted(own)
                firsts.append(len(items))
        return Windows(prints, maybe, h[hs], np.array(words_, np.int32), np.array(firsts, np.int32), np.array(items, np.int32))

    def text(self, word: int, length: int) -> bytes:
        return self.blob[self.at[word] : self.at[word + length] - 1]

    @property
    def nbytes(self) -> int:
        return len(self.blob) + self.at.nbytes + sum(x.nbytes for x in self.lengths.values())

    def hits(self, w: Words) -> tuple[np.ndarray, dict[int, set[str | None]]]:
        """Which words of w are hit, and the items found in each row."""
        hit = np.zeros(len(w.hash) + 1, dtype=np.int32)
        items: dict[int, set[str | None]] = defaultdict(set)
        for length, x in self.lengths.items():
            at, least = _fingerprints(w, length)
            near = np.flatnonzero(x.maybe[(least & np.uint64(len(x.maybe) - 1)).astype(np.int64)])
            near = near[x.prints[np.minimum(np.searchsorted(x.prints, least[near]), len(x.prints) - 1)] == least[near]]
            if not len(near):
                continue
            _, h = windows(w, length)  # at the same places
            h = h[near]
            spot = np.searchsorted(x.hash, h)
            own = (spot < len(x.hash)) & (x.hash[np.minimum(spot, len(x.hash) - 1)] == h)
            row = w.row
            for s, k in zip(at[near[own]].tolist(), spot[own].tolist()):
                text, same = w.text(s, s + length), x.hash[k]
                while k < len(x.hash) and x.hash[k] == same:
                    if self.text(int(x.word[k]), length) == text:
                        hit[s] += 1
                        hit[s + length] -= 1
                        items[int(row[s])].update(self.names[j] for j in x.item[x.first[k] : x.first[k + 1]].tolist())
                    k += 1
        return np.cumsum(hit[:-1]) > 0, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of at most `limit` bytes of text (one item at least); the driver holds a block at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string"), F.col(text).cast("string"))
    block, size = [], 0
    for i, t in rows.toLocalIterator():
        n = len(t.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += n
    if block:
        yield block


FOUND = ("n_words", "hit_words", "items")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = SPAN, block_bytes: int = BLOCK_BYTES, names: Sequence[str] = FOUND,
) -> DataFrame:
    """The columns `keep` of docs with n_words, hit_words (array<int>, places of hit words from 0) and items (array<string>).

    names: what these three are called.
    """
    keep = [c for c in keep if c.lower() not in names]
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return _one_pass(docs, keep, text, Index(block, span), names)
    # A text is judged by itself, so it is its own key.
    key, body = free_name(docs, "_key"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumn(key, F.md5(body))
    parts = []
    while block is not None:
        got = _one_pass(keyed.select(key, text), [key], text, Index(block, span), FOUND)
        parts.append(cut(got.where(F.size("hit_words") > 0).select(key, "hit_words", "items").dropDuplicates([key])))
        block, after = after, next(blocks, None)
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    own = free_name(keyed, "_found")
    found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(every("hit_words").alias("_w"), every("items").alias("_i"))
    out = keyed.join(found.select(F.col(key), F.struct("_w", "_i").alias(own)), key, "left")
    none = F.lit("[]")
    return out.select(
        *[F.col(f"`{c}`") for c in keep], F.regexp_count(ascii_lower(body), F.lit(_WORD)).cast("long").alias(names[0]),
        F.coalesce(F.col(own)["_w"], F.from_json(none, "array<int>")).alias(names[1]), F.coalesce(F.col(own)["_i"], F.from_json(none, "array<string>")).alias(names[2]),
    )


def _one_pass(docs: DataFrame, keep: list[str], text: str, index: Index, names: Sequence[str]) -> DataFrame:
    """What one block of the benchmark finds: columns `keep`, then n_words, hit_words and items."""
    out = T.StructType([docs.schema[c] for c in keep])
    out = out.add(names[0], T.LongType()).add(names[1], T.ArrayType(T.IntegerType())).add(names[2], T.ArrayType(T.StringType()))
    sent = keep if text in keep else [text, *keep]
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at, places = sent.index(text), [sent.index(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in slices(b.column(at).cast(pa.string()), ALNUM):
                hit, items = shared.value.hits(w)
                words, ids = ([[] for _ in range(j - i)] for _ in range(2))
                for r in np.unique(w.row[hit]).tolist():
                    words[r] = np.flatnonzero(hit[w.first[r] : w.first[r + 1]]).tolist()
                    ids[r] = _ordered(items[r])
                cols = [b.column(c).slice(i, j - i) for c in places]
                cols += [pa.array(w.counts.astype(np.int64)), pa.array(words, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, out)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows of which a word is hit; all columns, of any name, stay as they are."""
    names = hidden(docs, "_n_words", "_hit_words", "_items")
    found = decontaminate(docs, benchmark, docs.columns, names=names, **options)
    return found.where(F.size(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and the digest of each document's item ids, sorted as strings."""
    hits = F.size("hit_words").cast("long")
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select(doc_id, "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (hits > 0).alias("contaminated"))
