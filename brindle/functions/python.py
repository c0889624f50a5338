"""The few text functions that need Python: Unicode normal forms, recursive JSON, minimal windows. All by Arrow batches."""

from __future__ import annotations

import html.parser
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _strings(fn):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else fn(x))

    return run


def nfkc(text: Column) -> Column:
    return _strings(lambda t: unicodedata.normalize("NFKC", t))(text)


def normalize_space(text: Column) -> Column:
    """NFKC, no-break spaces, stripped lines, one blank line at most."""

    def one(t: str) -> str:
        lines = [" ".join(x.split()) for x in unicodedata.normalize("NFKC", t).replace(" ", " ").split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    return _strings(one)(text)


SENSITIVE = re.compile(r"password|passwd|pwd|secret|token|api_?key|authorization|credential|cookie|private_?key", re.I)


def sanitize_json(text: Column, redact_words: str = r"\b\d{3}-\d{2}-\d{4}\b|\b\S+@\S+\.\w{2,}\b", depth: int = 8, items: int = 100) -> Column:
    """Recursive redaction of strings; null for sensitive keys, too much depth or too many items."""
    rule = re.compile(redact_words)

    def walk(v, d):
        if d > depth:
            raise ValueError("too deep")
        if isinstance(v, str):
            return rule.sub("[REDACTED]", v)
        if isinstance(v, (list, dict)) and len(v) > items:
            raise ValueError("too many items")
        if isinstance(v, list):
            return [walk(x, d + 1) for x in v]
        if isinstance(v, dict):
            if any(SENSITIVE.search(k) for k in v):
                raise ValueError("sensitive key")
            return {k: walk(x, d + 1) for k, x in v.items()}
        return v

    def one(t: str):
        try:
            return json.dumps(walk(json.loads(t), 0), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return _strings(one)(text)


def minimal_window(terms: Column, tokens: Column) -> Column:
    """Tokens of the shortest run that holds every term which occurs; null for fewer than two such terms (M6)."""

    def shortest(want, have) -> int | None:
        need = set(want) & set(have)
        if len(need) < 2:
            return None
        last: dict[str, int] = {}
        best = None
        for i, t in enumerate(have):
            if t in need:
                last[t] = i
                if len(last) == len(need):
                    width = i - min(last.values()) + 1
                    best = width if best is None else min(best, width)
        return best

    @F.pandas_udf("int")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([shortest(a, b) for a, b in zip(q, d)], dtype="Int32")

    return run(terms, tokens)


class _Tables(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.tables, self.cell = 0, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append([])
        elif self.depth == 1 and tag == "tr":
            self.tables[-1].append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth = max(0, self.depth - 1)
        elif self.depth == 1 and tag in ("td", "th") and self.cell is not None:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_tables(page: Column) -> Column:
    """array<array<array<string>>>: outermost tables of two rows at least."""

    @F.pandas_udf("array<array<array<string>>>")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for p in pages:
            t = _Tables()
            t.feed(p or "")
            out.append([x for x in t.tables if len(x) >= 2])
        return pd.Series(out)

    return run(page)


def markup_tables(text: Column) -> Column:
    """array<array<array<string>>>: the Markdown tables of a text outside code fences, head first, then its outermost HTML tables."""

    @F.pandas_udf("array<array<array<string>>>")
    def run(texts: pd.Series) -> pd.Series:
        from brindle.operators.chunking import markdown_tables

        out = []
        for t in texts:
            parser = _Tables()
            parser.feed(t or "")
            pipes = [[heads, *[[r[h] for h in heads] for r in rows]] for _, heads, rows, _ in markdown_tables(t or "")]
            out.append(pipes + [x for x in parser.tables if len(x) >= 2])
        return pd.Series(out)

    return run(text)
