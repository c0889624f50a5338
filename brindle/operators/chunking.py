"""Chunkers: text in, ordered chunks out.

Word windows, record groups, heading sections and page numbers are column expressions and windows; the parsers whose state runs
over lines are plain generators that `chunk_documents` applies to Arrow batches. A chunk is (ordinal, text, heading_path,
token_count, first_line, last_line, kind).
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import text as tx

CHUNK = "ordinal int, text string, heading_path array<string>, token_count int, first_line int, last_line int, page int, kind string, severity string"


@dataclass
class Chunk:
    text: str
    path: list[str] = field(default_factory=list)
    first: int | None = None
    last: int | None = None
    page: int | None = None
    kind: str = "text"
    severity: str | None = None

    @property
    def tokens(self) -> int:
        return max(1, len(self.text.split()) * 4 // 3)


# ---- column expressions -------------------------------------------------------------------------------------------------


def window_size(max_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """Words of a window and words that two windows share."""
    return max(80, max_tokens * 3 // 4), max(0, overlap_tokens * 3 // 4)


def word_windows(text: Column, max_tokens: int = 800, overlap_tokens: int = 120) -> Column:
    """array<string> (C2): the text as it is where it fits, else overlapping windows of words joined by single spaces."""
    size, shared = window_size(max_tokens, overlap_tokens)
    words = tx.words(text)
    n, step = F.size(words), max(size - shared, 1)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
    return F.when(n <= size, F.array(text)).otherwise(parts)


def chunk_words(docs: DataFrame, text: str = "text", max_tokens: int = 800, overlap_tokens: int = 120) -> DataFrame:
    """docs without the text, one row for each window: ordinal, text, token_count."""
    cols = [c for c in docs.columns if c != text]
    out = docs.select(*cols, F.posexplode(word_windows(F.col(text), max_tokens, overlap_tokens)).alias("ordinal", text))
    return out.withColumn("token_count", tx.estimate_tokens(F.col(text)))


def record_groups(df: DataFrame, keys: list[str], order: list[str], partition: list[str] = (), most: int = 25) -> DataFrame:
    """Rows of a table as text chunks of `most` records, with their fields and range in front (C4).

    Without a partition the rows are numbered over the whole table, by counts of their range partitions rather than one sort.
    """
    if partition:
        numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    else:
        from brindle.operators.paging import global_rank

        numbered = global_rank(df, order, "_n")
    numbered = numbered.withColumn("_g", F.floor((F.col("_n") - 1) / most).cast("int"))
    fields = F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys])
    line = F.concat(F.lit("Record "), F.col("_n").cast("string"), F.lit(": "), fields)
    rows = numbered.groupBy(*partition, "_g").agg(F.min("_n").alias("a"), F.max("_n").alias("b"), F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))).alias("rows"))
    head = F.concat(F.lit(f"Schema fields: {', '.join(keys)}\nRecord range: "), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit("\n"))
    text = F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return rows.select(*partition, F.col("_g").alias("ordinal"), F.col("a").alias("record_start"), F.col("b").alias("record_end"), text.alias("text"))


def heading_sections(docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(doc_id, section, heading_path, text, first_line, last_line): sections at `#` headings with the stack above them.

    The stack's entry at a level is the last heading there since one of a higher rank, which windows over the document's lines
    give; one document's lines are one window.
    """
    lines = docs.select(doc_id, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 1)
    lines = lines.withColumn("level", F.nullif(F.length(mark), F.lit(0))).withColumn("title", F.trim(F.regexp_extract("line", r"^(#{1,6})\s+(.*)$", 2)))
    upto = Window.partitionBy(doc_id).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count("level").over(upto))
    for k in range(1, 7):
        at = F.last(F.when(F.col("level") == k, F.struct("i", "title")), ignorenulls=True).over(upto)
        above = F.max(F.when(F.col("level") < k, F.col("i"))).over(upto) if k > 1 else F.lit(None).cast("int")
        lines = lines.withColumn(f"h{k}", F.when(at["i"] > F.coalesce(above, F.lit(-1)), at["title"]))
    own = Window.partitionBy(doc_id, "section")
    first = F.min("i").over(own)
    path = F.array_compact(F.array(*[F.first(f"h{k}").over(own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) for k in range(1, 7)]))
    lines = lines.withColumn("first_line", first + 1).withColumn("heading_path", path)
    out = lines.groupBy(doc_id, "section").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.first("heading_path").alias("heading_path"), F.min("first_line").alias("first_line"), (F.max("i") + 1).alias("last_line"),
    )
    stripped = F.regexp_replace(F.col("text"), r"^\s+|\s+$", "")
    return out.withColumn("text", stripped).where("text <> ''").select(doc_id, "section", "heading_path", "text", "first_line", "last_line")


def fill_pages(chunks: DataFrame, doc_id: str, order: str, text: str = "text") -> DataFrame:
    """Adds page: the last page marker in this chunk or before it."""
    marker = r"(?im)<!--\s*page[:=]\s*(\d+)\s*-->|^\s*Page\s+(\d+)\b"
    own = F.coalesce(*[F.nullif(F.regexp_extract(text, marker, g), F.lit("")) for g in (1, 2)]).cast("int")
    upto = Window.partitionBy(doc_id).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("page", F.last(own, ignorenulls=True).over(upto))


def page_markers(text: Column) -> Column:
    """Page numbers that the text marks, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)(<!--\s*page[:=]\s*\d+\s*-->|^\s*Page\s+\d+\b)"))
    return F.transform(found, lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))


def markers_complete(markers: Column) -> Column:
    return F.when(F.size(markers) == 0, F.lit(False)).otherwise(markers == F.sequence(F.get(markers, 0), F.get(markers, 0) + F.size(markers) - 1))


def log_windows(text: Column, most: int = 80, overlap: int = 10) -> Column:
    """array<string>: fixed windows of lines."""
    lines = F.split(text, "\n", -1)
    last = F.greatest(F.lit(0), F.ceil((F.size(lines) - most) / (most - overlap))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(lines, i * (most - overlap) + 1, F.lit(most)), "\n"))


# ---- generators ---------------------------------------------------------------------------------------------------------


def split_words(text: str, max_tokens: int, overlap_tokens: int) -> Iterator[str]:
    size, shared = window_size(max_tokens, overlap_tokens)
    words = text.split()
    if len(words) <= size:
        yield text
        return
    for at in range(0, len(words), max(size - shared, 1)):
        yield " ".join(words[at : at + size])
        if at + size >= len(words):
            return


_HEADING = re.compile(r"^(#{1,6})\s+(.*)$")


def by_headings(text: str, max_tokens: int = 800, overlap_tokens: int = 120) -> Iterator[Chunk]:
    path: list[str] = []
    held: list[str] = []
    first = 0

    def section(last: int) -> Iterator[Chunk]:
        if body := "\n".join(held).strip():
            for part in split_words(body, max_tokens, overlap_tokens):
                yield Chunk(part, list(path), first + 1, last, kind="heading")

    lines = text.split("\n")
    for i, line in enumerate(lines):
        if m := _HEADING.match(line):
            yield from section(i)
            held, first = [], i
            path = [*path[: len(m[1]) - 1], m[2].strip()]
        held.append(line)
    yield from section(len(lines))


# Fixed value: the two ways in which a text marks a page.
_PAGE = re.compile(r"<!--\s*page[:=]\s*(\d+)\s*-->|^\s*Page\s+(\d+)\b", re.I | re.M)


def by_pages(text: str) -> Iterator[Chunk]:
    page = None
    for c in by_headings(text, 900, 160):
        if m := _PAGE.search(c.text):
            page = int(m[1] or m[2])
        c.page, c.kind = page, "pdf_markdown"
        yield c


def record_chunks(records: list[dict], keys: list[str], path: list[str], kind: str, lead: list[str] = (), first_line: int | None = None, most: int = 25) -> Iterator[Chunk]:
    for at in range(0, len(records), most):
        group = records[at : at + most]
        lines = [*lead, f"Schema fields: {', '.join(keys)}", f"Record range: {at + 1}-{at + len(group)}"]
        for k, r in enumerate(group, at + 1):
            lines.append(f"Record {k}: " + " | ".join(f"{f}: {r[f]}" for f in keys if f in r))
        span = (None, None) if first_line is None else (first_line + at, first_line + at + len(group) - 1)
        yield Chunk("\n".join(lines), path, *span, kind=kind)


def _cells(line: str) -> list[str]:
    line = line.strip()
    if "|" not in line:
        return []
    cells = [" ".join(c.split()) for c in line.removeprefix("|").removesuffix("|").split("|")]
    return cells if len(cells) > 1 else []


def _is_rule(line: str) -> bool:
    cells = _cells(line)
    return bool(cells) and all(re.fullmatch(r":?-{3,}:?", c.replace(" ", "")) for c in cells)


def markdown_tables(text: str) -> Iterator[tuple[str | None, list[str], list[dict], int]]:
    """(caption, headers, rows, first row's line) of each table outside code fences."""
    lines, fenced, inside = text.split("\n"), [], False
    for line in lines:
        fence = bool(re.match(r"\s*(```|~~~)", line))
        fenced.append(inside or fence)
        inside ^= fence
    i = 0
    while i + 1 < len(lines):
        heads = _cells(lines[i])
        if fenced[i] or fenced[i + 1] or not heads or not _is_rule(lines[i + 1]):
            i += 1
            continue
        end, rows = i + 2, []
        while end < len(lines) and not fenced[end] and (cells := _cells(lines[end])) and not _is_rule(lines[end]):
            rows.append(dict(zip(heads, [*cells, *[""] * len(heads)])))
            end += 1
        if rows:
            above = next((x.strip().strip("#").strip() for x in reversed(lines[:i]) if x.strip()), "")
            yield (above if above and "|" not in above else None), heads, rows, i + 3
        i = end if rows else i + 1


def _delimited(text: str) -> list[dict]:
    lines = [x for x in text.split("\n") if x.strip()]
    mark = next((d for d in "\t,;" if len(lines) > 1 and d in lines[0]), None)
    if mark is None:
        return []
    reader = csv.DictReader(io.StringIO(text), delimiter=mark)
    if len([n for n in reader.fieldnames or [] if n]) < 2:
        return []
    return [{k: v for k, v in r.items() if k} for r in reader if any(v not in (None, "") for v in r.values())]


def _json_records(value) -> list[dict]:
    own = lambda v: v if isinstance(v, dict) else {"value": v}
    if isinstance(value, list):
        return [own(v) for v in value]
    if not isinstance(value, dict):
        return [own(value)]
    if not any(isinstance(v, (list, dict)) for v in value.values()):
        return [value]
    out = []
    for k, v in value.items():
        out += [{"_collection": k, **own(x)} for x in v] if isinstance(v, list) else [{"_key": k, **own(v)}]
    return out


def by_records(text: str) -> Iterator[Chunk]:
    """JSON, else Markdown tables, else delimited rows, else headings."""
    if not text.strip():
        return
    try:
        records = _json_records(json.loads(text))
    except ValueError:
        found = False
        for k, (caption, heads, rows, line) in enumerate(markdown_tables(text), 1):
            found, name = True, caption or f"table_{k}"
            yield from record_chunks(rows, list(dict.fromkeys(heads)), ["markdown_table", name], "markdown_table", [f"Markdown table {k}: {name}"], line)
        if found:
            return
        records = _delimited(text)
    if records:
        yield from record_chunks(records, sorted({k for r in records for k in r}), ["structured_records"], "records")
    else:
        yield from by_headings(text)


_NAME = r"(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)"
_ACCESS = "public|private|protected|internal"
#: How a line begins a definition, a language family at a time: words that may stand before, the keyword, the name.
_DEFINITIONS = tuple(
    re.compile(p)
    for p in (
        rf"\s*(?:async )?(?:def|class) +{_NAME}",  # Python
        rf"\s*(?:export )?(?:default )?(?:abstract )?(?:async )?(?:function\*? *|class +|interface +|enum +){_NAME}",  # JavaScript, TypeScript
        rf"\s*(?:export )?(?:const|let|var) +{_NAME} *(?::[^=]+)?= *(?:async *)?(?:\([^()]*\)|[A-Za-z_$][A-Za-z0-9_$]*) *(?::[^=]+)?=>",
        rf"func +(?:\([^()]*\) *)?{_NAME}",  # Go
        rf"\s*(?:pub(?:\([a-z]+\))? )?(?:async |unsafe |const )*(?:fn|struct|enum|trait|mod) +{_NAME}",  # Rust
        rf"\s*(?:unsafe )?impl(?: *<[^>]*>)? +{_NAME}",
        rf"\s*(?:(?:{_ACCESS}|static|final|abstract|sealed|open|data|inner|partial) +)*(?:class|interface|enum|record|object|struct) +{_NAME}",  # JVM, C#
        rf"\s*(?:(?:{_ACCESS}|override|suspend|open|inline) +)*fun +{_NAME}",
        rf"\s*(?:{_ACCESS}|static)\b[^=;(]*?{_NAME} *\(",  # a method's type and name
    )
)


def symbol_of(line: str) -> str | None:
    """The name of the definition that the line begins; None if it begins none."""
    return next((m["name"] for p in _DEFINITIONS if (m := p.match(line))), None)


def by_symbols(text: str) -> Iterator[Chunk]:
    """A chunk for each definition that a line begins, and one for what stands before the first."""
    lines = text.split("\n")
    starts = [(i, name) for i, x in enumerate(lines) if (name := symbol_of(x))]
    if not starts:
        for part in split_words(text, 900, 80):
            yield Chunk(part, ["code"], kind="code")
        return
    if head := "\n".join(lines[: starts[0][0]]).strip():
        yield Chunk(head, ["module_preamble"], 1, starts[0][0], kind="code")
    for (a, name), (b, _) in zip(starts, [*starts[1:], (len(lines), "")]):
        if body := "\n".join(lines[a:b]).strip():
            for part in split_words(body, 900, 80):
                yield Chunk(part, [name], a + 1, b, kind="code")


# Levels of a log from the gravest down, and how an event's first line begins.
_LEVELS = "FATAL|ERROR|WARN|INFO|DEBUG|TRACE"
_EVENT = re.compile(rf"\s*(?:\d{{4}}-\d\d-\d\d[T\s]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?\b|\[(?:{_LEVELS})\]|(?:{_LEVELS})\b)")


def _gravest(text: str) -> str | None:
    return next((s for s in _LEVELS.split("|") if re.search(rf"\b{s}\b", text)), None)


def by_events(text: str, most: int = 80, overlap: int = 10) -> Iterator[Chunk]:
    """Whole log events packed up to `most` lines; the next chunk goes back over whole events of `overlap` lines."""
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if _EVENT.match(x)]

    def chunk(a: int, b: int) -> Iterator[Chunk]:
        if body := "\n".join(lines[a:b]).strip():
            s = _gravest(body)
            yield Chunk(body, ["logs", s or "events"], a + 1, b, kind="log", severity=s)

    if not starts:
        for a in range(0, len(lines), most - overlap):
            yield from chunk(a, min(a + most, len(lines)))
            if a + most >= len(lines):
                return
        return
    edges = [*starts, len(lines)]
    at = 0
    while True:
        end = at + 1
        while end < len(starts) and edges[end + 1] - edges[at] <= most:
            end += 1
        yield from chunk(edges[at], edges[end])
        if end == len(starts):
            return
        back, left = end, overlap
        while back > at + 1 and left > 0:
            back -= 1
            left -= edges[back + 1] - edges[back]
        at = max(back, at + 1)


def exact_pages(text: str, max_tokens: int = 800, overlap_tokens: int = 120, sha256: str | None = None, pages: int | None = None) -> Iterator[Chunk]:
    """Exact slices of a page-marked text, 4096 characters at most, cut at headings, paragraphs or words (C11).

    Refuses a text whose digest or page markers aren't as declared. Every chunk is a substring of its page, in order.
    """
    if sha256 and hashlib.sha256(text.encode()).hexdigest() != sha256:
        raise ValueError("the text isn't the one that was declared")
    marks = list(_PAGE.finditer(text))
    numbers = [int(m[1] or m[2]) for m in marks]
    if not numbers or numbers != list(range(numbers[0], numbers[0] + len(numbers))) or pages not in (None, len(numbers)):
        raise ValueError("page markers are missing or out of order")
    size, shared = window_size(max_tokens, overlap_tokens)
    for m, page, end in zip(marks, numbers, [*(x.start() for x in marks[1:]), len(text)]):
        at = m.end()
        while at < end:
            stop = min(end, at + 4096)
            spans = [x.span() for x in re.finditer(r"\S+", text[at:stop])]
            if len(spans) > size:
                stop = at + spans[size - 1][1]
            if stop < end:
                better = max(text.rfind("\n#", at + 1, stop), text.rfind("\n\n", at + 1, stop))
                stop = better if better > at + (stop - at) // 2 else (text.rfind(" ", at + 1, stop) if stop - at == 4096 and " " in text[at + 1 : stop] else stop)
            if text[at:stop].strip():
                yield Chunk(text[at:stop], [], page=page, kind="page")
            if stop >= end:
                break
            tail = [x.start() for x in re.finditer(r"\S+", text[at:stop])]
            back = at + tail[-shared] if shared and len(tail) > shared else stop
            at = back if back > at else stop


_TRAILING = ("history", "source or prior law", "cross references", "law review and bar journal references", "case annotations")


def parse_statute(text: str) -> dict[str, str]:
    """Title, source url, body and trailing sections of a statute's Markdown."""
    lines = text.split("\n")
    title = next((x.lstrip("# ").strip() for x in lines if x.startswith("#")), "")
    url = next((m[1] for x in lines if (m := re.match(r"(?i)source:\s*<?(\S+?)>?\s*$", x))), "")
    out, name = {"title": title, "source_url": url, "body": ""}, "body"
    for x in lines:
        if m := re.match(r"#{2,6}\s+(.*)$", x):
            name = m[1].strip().lower() if m[1].strip().lower().rstrip(":") in _TRAILING else "body"
            if name != "body":
                continue
        if x.startswith("# ") or re.match(r"(?i)source:", x):
            continue
        out[name] = (out.get(name, "") + "\n" + x).strip("\n")
    return out


def by_statute(text: str) -> Iterator[Chunk]:
    """The body at subsections, then each trailing section."""
    parts = parse_statute(text)
    for piece in re.split(r"\n(?=\([a-z0-9]+\)\s)|\n\n+", parts["body"]):
        if piece.strip():
            for p in split_words(piece.strip(), 800, 120):
                yield Chunk(p, [parts["title"]], kind="statute_body")
    for name in _TRAILING:
        if parts.get(name, "").strip():
            for p in split_words(parts[name].strip(), 800, 120):
                yield Chunk(p, [parts["title"], name], kind="statute_metadata")


#: Mode to chunker (C14); any other mode goes by headings.
CHUNKERS: dict[str, Callable[[str], Iterator[Chunk]]] = {
    "pdf_markdown_external_v1": by_pages,
    "raw_pdf_research_v1": by_pages,
    "code_repo_v1": by_symbols,
    "tables_csv_json_v1": by_records,
    "logs_errors_v1": by_events,
    "statute_v1": by_statute,
    "page_exact_v1": exact_pages,
}


#: Chunks that a task holds before it hands them on.
CHUNKS_AT_A_TIME = 2000


def chunk_documents(docs: DataFrame, keep: list[str], text: str = "text", mode: str | Column = "markdown_docs_v1") -> DataFrame:
    """The columns `keep` and one row for each chunk; each row's mode picks its chunker. A null text has no chunks."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    rows = docs.select(*keep, mode.alias("_mode"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), CHUNK])
    names = [*keep, *(c.split()[0] for c in CHUNK.split(", "))]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names).astype({c: "Int32" for c in ("ordinal", "token_count", "first_line", "last_line", "page")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for b in batches:
            for *own, how, body in b.itertuples(index=False, name=None):
                for i, c in enumerate(CHUNKERS.get(how, by_headings)(body) if body else ()):
                    out.append((*own, i, c.text, c.path, c.tokens, c.first, c.last, c.page, c.kind, c.severity))
                    if len(out) >= CHUNKS_AT_A_TIME:
                        yield frame(out)
                        out = []
        yield frame(out)

    return rows.mapInPandas(run, schema)


def plan_batches(rows: DataFrame, key: str, order: str, tokens: Column, budget: int, most: int) -> DataFrame:
    """Adds batch: rows of a key, in order, packed up to `budget` tokens and `most` rows each."""
    schema = rows.withColumn("_t", tokens.cast("long")).withColumn("batch", F.lit(0)).schema

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch, used, n, out = pdf.sort_values(order), 0, 0, 0, []
        for t in pdf["_t"]:
            if n and (used + t > budget or n >= most):
                batch, used, n = batch + 1, 0, 0
            used, n = used + t, n + 1
            out.append(batch)
        return pdf.assign(batch=pd.Series(out, index=pdf.index, dtype="int32"))

    return rows.withColumn("_t", tokens.cast("long")).groupBy(key).applyInPandas(pack, schema).drop("_t")
