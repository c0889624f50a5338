"""Token counts by prefix dynamic programming over a BPE piece model.

A BPE encoding has one property that makes counting incremental: a sequence of pieces is the encoding of their joined text
exactly when each piece encodes to itself and each adjacent pair of pieces encodes to itself. So the encoding of every prefix
of a text ends with one determined piece, and

    count[i] = count[i - len(piece)] + 1

where `piece` is the one piece ending at i that may follow the last piece of the prefix before it. One pass over the text
gives the count of *every* prefix, and truncation or budget questions become look-ups in that array.

No piece of such a model crosses from a non-space to a space, and a character outside the vocabulary (line feeds among them)
becomes its UTF-8 bytes on its own; the text therefore falls into segments whose tables are independent. A segment's last entry,
its total, is kept in a bounded memo, as a corpus repeats its words; the table over a whole text is made of its segments' tables,
each moved by the totals before it, so a text's count is a sum of last entries and a budget's cut needs the table of the one
segment in which the budget ends. What the recurrence takes for granted is checked when a model is loaded, and a model for which
it doesn't hold is refused.

Cases: a null text counts as the empty one (0 tokens, one prefix); strings of control pieces such as `<s>` are plain text, as
the library treats them by default; white space is counted as it stands, nothing is stripped; a text of any length is counted
whole; repeated rows count alike, an empty table gives an empty result; columns of the result's names are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.session import free_name

#: Entries a worker keeps of segments and of pairs; beyond it the memo starts anew, which costs time and changes no result.
MEMO_ENTRIES = 500_000
#: Longer segments aren't kept, as they hardly come again.
MEMO_CHARS = 64
#: Texts that are cut into segments at a time.
TEXTS = 256
_SEGMENT = re.compile("▁*[^▁\n]+|▁+|\n")
#: Texts on which the recurrence must agree with the library before a model is used.
_PROBES = (
    "a", " a", "a ", "  a  b  ", "The quick brown fox", "internationalisation antidisestablishmentarianism", "x\n\ny\t z\r\n", "\n", " ", "   ", "▁a▁ b",
    "ﬁ Ⅳ ａＢ １２ ①", "e\u0301 é ß ẞ İ", "日本語 한국어 中文", "😀👩‍👩‍👧 \u200b\ufeff\u00a0 x", "<s> </s> <unk> <pad> <0x0A> <|im_end|>", "\x00\x01\x7f", "1234567890 3.14 1e-9",
    "https://example.org/a?b=c&d#e", "def f(x): return {x: [1, 2]}", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "Don't \"quote\" - (it)...",
)


class PrefixCounter:
    """Exact token counts at all prefixes of texts, for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.lib.get_piece_size()
        self.score = {
            self.lib.id_to_piece(i): self.lib.get_score(i)
            for i in range(n)
            if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i) or self.lib.is_unused(i))
        }
        #: Pieces by their characters from the last one back; a node's piece, if it has one, is under "".
        self.ending: dict = {}
        for p in self.score:
            node = self.ending
            for ch in reversed(p):
                node = node.setdefault(ch, {})
            node[""] = p
        self.totals: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.whole: dict[str, tuple[str, str, bool] | None] = {}
        self._check(n)

    def _check(self, n: int) -> None:
        if sum(self.lib.is_byte(i) for i in range(n)) != 256:
            raise ValueError("the model has no byte for each unknown character")
        if any("▁" in p.lstrip("▁") or "\n" in p for p in self.score):
            raise ValueError("the model has pieces across a space or a line feed")
        for t in _PROBES:
            if self.prefix_counts(t)[-1] != len(self.lib.encode(t)):
                raise ValueError(f"the model doesn't encode {t!r} by merges of plain pieces")

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The pieces of a short text by merging the best-scored neighbours, leftmost first among equals; and the last two merged."""
        last = ("", "")
        part, score = list(text), self.score
        n = len(part)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[a + b], i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in score]
        heapify(heap)
        while heap:
            _, i, both = heappop(heap)
            j = nxt[i] if part[i] else n
            if j >= n or part[i] + part[j] != both:
                continue
            last = (part[i], part[j])
            part[i], part[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (x := both + part[nxt[i]]) in score:
                    heappush(heap, (-score[x], i, x))
            if prv[i] >= 0 and (x := part[prv[i]] + both) in score:
                heappush(heap, (-score[x], prv[i], x))
        return [x for x in part if x], last

    def _alone(self, piece: str) -> tuple[str, str, bool] | None:
        """Of a piece that encodes to itself its two halves, and whether all its merges come in the order of their scores."""
        if piece not in self.whole:
            got, (left, right) = self.merge(piece)
            if got != [piece]:
                self.whole[piece] = None
            elif len(piece) == 1:
                self.whole[piece] = ("", "", True)
            else:
                halves = [h for h in (left, right) if len(h) > 1]
                tame = all(self.score[h] > self.score[piece] and (self._alone(h) or ("", "", False))[2] for h in halves)
                self.whole[piece] = (left, right, tame)
        return self.whole[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether the two pieces, joined, encode to these two.

        Undoes the merges of both from the last one back: had a merge across the border been due before the one undone, it would
        have been made. That holds where merges come in the order of their scores; other pieces are encoded together.
        """
        whole, score = self.whole, self.score
        if not (whole[left][2] and whole[right][2]):
            return self.merge(left + right)[0] == [left, right]
        if left + right in score:
            return False
        while True:
            a, b = len(left) > 1, len(right) > 1
            if a and (not b or score[left] < score[right]):
                due, left = score[left], whole[left][1]
                if score.get(left + right, due) > due:
                    return False
            elif b:  # of equal scores the left one is merged first
                due, right = score[right], whole[right][0]
                if (s := score.get(left + right)) is not None and s >= due:
                    return False
            else:
                return True

    def _follows(self, left: str, right: str) -> bool:
        after = self.pairs.get(left)
        if after is None:
            after = self.pairs[left] = {}
        if (known := after.get(right)) is None:
            if self.n_pairs >= MEMO_ENTRIES:
                self.pairs, self.n_pairs = {left: (after := {})}, 0
            self.n_pairs += 1
            known = after[right] = self._apart(left, right)
        return known

    def segment_counts(self, seg: str) -> list[int]:
        """Token counts of the prefixes of one segment, the empty one first."""
        score, ending, whole, follows = self.score, self.ending, self.whole, self._follows
        counts, last = [0], [""]
        for i in range(1, len(seg) + 1):
            node, found, j = ending, [], i
            while j and (node := node.get(seg[j - 1])) is not None:
                j -= 1
                if "" in node:
                    found.append(node[""])
            for piece in reversed(found):
                j = i - len(piece)
                if (whole[piece] if piece in whole else self._alone(piece)) and (not j or (before := last[j]) not in score or follows(before, piece)):
                    counts.append(counts[j] + 1)
                    last.append(piece)
                    break
            else:
                if found:
                    raise AssertionError("no piece ends here; the model isn't a BPE model")
                counts.append(counts[-1] + len(seg[i - 1].encode()))  # a character without a piece joins with nothing
                last.append(seg[i - 1])
        return counts

    def _segments(self, text: str) -> list[str]:
        return _SEGMENT.findall("▁" + text.replace(" ", "▁")) if text else []

    def _total(self, seg: str) -> int:
        """The last entry of a segment's table. The memo has two halves: the older goes when the newer is full."""
        known = self.totals.get(seg)
        if known is None:
            known = self.before.get(seg)
            if known is None:
                known = self.segment_counts(seg)[-1]
            if len(seg) <= MEMO_CHARS:
                if len(self.totals) >= MEMO_ENTRIES:
                    self.totals, self.before = {}, self.totals
                self.totals[seg] = known
        return known

    def counts_of(self, texts: list[str], budget: int | None = None) -> list[tuple[int, int]]:
        """Of each text the last entry of its table, the sum of its segments' last entries, and its cut at the budget."""
        rows = [self._segments(t) for t in texts]
        own = {seg: self._total(seg) for seg in set().union(*rows)}
        n = [sum(map(own.__getitem__, row)) for row in rows]
        return [(k, len(t) if budget is None or k <= budget else self._cut(row, [*map(own.__getitem__, row)], budget)) for k, t, row in zip(n, texts, rows)]

    def prefix_counts(self, text: str) -> list[int]:
        """counts[i]: tokens of text[:i], for i from 0 to len(text)."""
        out, base = [0], 0
        for k, seg in enumerate(self._segments(text)):
            own = self.segment_counts(seg)
            out += [base + c for c in own[1 + (k == 0) :]]  # the first segment begins with the model's own space
            base += own[-1]
        return out

    def truncate(self, text: str, budget: int) -> int:
        """The largest i for which text[:i] has at most `budget` tokens."""
        return self.counts_of([text], budget)[0][1]

    def _cut(self, segments: list[str], totals: list[int], budget: int) -> int:
        # Counts aren't monotone inside a segment, but every prefix has at least the tokens of the segments before it and one more.
        base = [0, *accumulate(totals)]
        for k in range(bisect_right(base, budget - 1) - 1, -1, -1):  # the last segment that begins below the budget, or one before
            own = self.segment_counts(segments[k])
            if fit := [i for i, c in enumerate(own) if i > (k == 0) and base[k] + c <= budget]:
                return sum(map(len, segments[:k])) + fit[-1] - 1
        return 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """One counter for each worker and model; `model` is a file name that public_tokenizers.path() resolves, or a path."""
    if model not in _COUNTERS:
        import public_tokenizers

        _COUNTERS[model] = PrefixCounter(model if "/" in model else public_tokenizers.path(model))
    return _COUNTERS[model]


def token_count(text: Column, model: str) -> Column:
    """Tokens of the whole text, null as the empty one."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for texts in batches:
            rows = texts.tolist()
            yield pd.Series([n for i in range(0, len(rows), TEXTS) for n, _ in c.counts_of(rows[i : i + TEXTS])], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def budget_cut(text: Column, model: str, budget: int) -> Column:
    """The most code points from the start that have at most `budget` tokens."""

    @F.pandas_udf(T.LongType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for texts in batches:
            yield pd.Series([c.truncate(t, budget) for t in texts], dtype="int64")

    return cut(F.coalesce(text, F.lit("")))


def prefix_token_counts(text: Column, model: str) -> Column:
    """array<int> with the token count of every prefix, counted in code points from the empty prefix on."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(model)
        for texts in batches:
            yield pd.Series([c.prefix_counts(t) for t in texts], dtype="object")

    return counts(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, model: str, limit: int, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit (n_tokens > limit) and cut_chars (code points that fit the limit)."""

    @F.pandas_udf("n_tokens bigint, cut_chars bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(model)
        for texts in batches:
            rows = texts.tolist()
            got = [x for i in range(0, len(rows), TEXTS) for x in c.counts_of(rows[i : i + TEXTS], limit)]
            yield pd.DataFrame(got, columns=["n_tokens", "cut_chars"], dtype="int64")

    body, made = F.coalesce(F.col(text), F.lit("")), free_name(docs, "_made")
    out = docs.withColumn(made, count(body)).withColumn("n_bytes", F.octet_length(body).cast("long"))
    out = out.withColumn("n_tokens", F.col(made)["n_tokens"]).withColumn("over_limit", F.col("n_tokens") > limit)
    return out.withColumn("cut_chars", F.col(made)["cut_chars"]).drop(made)
