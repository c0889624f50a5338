"""Quality rules: statistics of each text, and lines that too many documents of one host share.

Each line is normalised (digits to 0, A-Z lower-cased, runs of white space to one space, trimmed) and hashed; for each host and
hash the distinct documents that hold the line are counted. A line is boilerplate where more than LEAST_DOCS documents of its host
and more than MAX_SHARE of them hold it; such lines are removed, and a document keeps its place if enough of its words remain.

The text is read once: a table keeps each row's statistics and its lines as (hash, words). Counts are added up before they move,
and lines above the limit join back by (host, line), in which a hot line is split by the skew join.

A document is a different pair of id and text: rows equal in both, and in host, count once, and a line counts once for a document.

Cases: a null or empty text has no words and no lines, and fails the base rules; a null host is a host of its own, a null id an id
like others; repeated rows are judged alike, one row each; very long texts and lines are taken whole; an empty table gives an empty
result; other columns pass, those of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.session import SPACE_WORD, ascii_lower, cut, free_name, hidden

#: Documents of one host that may share a line: so many, or this share of the host's documents where that is more.
LEAST_DOCS, MAX_SHARE = 3, 0.05
#: Share of its words that a document must keep.
MIN_LEFT = 0.3
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({SPACE_WORD})"), F.lit(1))


def with_repeat_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """Adds, of the hashes of a text's words, the words inside windows of REPEAT_WINDOW that occur twice or more, first included.

    Sorted by hash, equal windows are neighbours; sorted by place, what they cover adds up. Each step is a column of its own,
    as a lambda would work out anew what it names.
    """
    k = REPEAT_WINDOW
    g, at, again = free_name(df, "_g"), free_name(df, "_at"), free_name(df, "_again")
    spots = F.sequence(F.lit(0), F.size(hashes) - k)
    df = df.withColumn(g, F.when(F.size(hashes) > k, F.transform(spots, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))))
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    df = df.withColumn(at, F.when(F.size(F.array_distinct(g)) < F.size(g), pairs))
    twice = F.filter(at, lambda x, i: (F.get(at, i - 1)["g"] == x["g"]) | (F.get(at, i + 1)["g"] == x["g"]))
    df = df.withColumn(again, F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(
        again, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(k), p - a["last"])).alias("n")), lambda a: a["n"]
    )
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop(g, at, again)


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    t, h = free_name(docs, "_t"), free_name(docs, "_h")
    out = docs.drop(*(c for c in docs.columns if c.lower() in names and c != text)).withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(h, F.transform(words_of(F.col(t)), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(SPACE_WORD))
    bare = F.translate(F.col(t), " \t\n\x0b\x0c\r", "")
    out = out.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(bare).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.when(F.instr(t, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0).cast("long"),
        }
    )
    out = with_repeat_words(out, h, "n_repeat_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(t, h)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(ascii_lower(line), "123456789", "000000000"), r"[\x20\x09-\x0D]+", " "))


def line_list(text: Column) -> Column:
    """array<struct<h, n>>: the text's lines with words, as hashes of their normal form, with their words."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normal_line)
    # A normal line's words are its spaces and one.
    sized = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))
    return F.filter(sized, lambda x: x["n"] > 0)


def common_lines(documents: DataFrame, least: int, share: float) -> DataFrame:
    """(host, line) above the limit, of different documents (host, lines)."""
    held = documents.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    sizes = documents.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("docs"))
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > F.col("docs") * share).select("host", "line")


def _documents(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "digest", "digest2", "host").agg(F.first("lines").alias("lines"))


def _digests(text: Column) -> tuple[Column, Column]:
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(1), t)


def apply_rules(
    docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", least: int = LEAST_DOCS, share: float = MAX_SHARE, min_left: float = MIN_LEFT
) -> DataFrame:
    """docs without the text, with the statistics, n_removed (words of removed lines) and kept."""
    row = free_name(docs, "_row")
    one, two = _digests(F.col(text))
    key = F.struct(F.col(doc_id).alias("id"), one.alias("digest"), two.alias("digest2"), F.col(host).alias("host"), line_list(F.col(text)).alias("lines"))
    rows = cut(add_statistics(docs.withColumn(row, key), text).drop(text, "n_removed", "kept"))
    documents = _documents(rows.select(f"{row}.*"))
    documents = cut(documents)
    lines = documents.select("id", "digest", "digest2", "host", F.explode("lines").alias("l"))
    l, c = lines.alias("l"), common_lines(documents, least, share).alias("c")
    hit = l.join(c, F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.l.h") == F.col("c.line")), "left_semi")
    gone = hit.groupBy("id", "digest", "digest2", "host").agg(F.sum("l.n").alias("n"))
    mark = free_name(rows, "_gone")
    g = gone.select(F.struct("id", "digest", "digest2", "host", "n").alias(mark))
    own, its = F.col(row), F.col(mark)
    same = own["id"].eqNullSafe(its["id"]) & (own["digest"] == its["digest"]) & (own["digest2"] == its["digest2"]) & own["host"].eqNullSafe(its["host"])
    out = rows.join(g, same, "left").withColumn("n_removed", F.coalesce(its["n"], F.lit(0)))
    left = F.col("n_words") - F.col("n_removed")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= F.col("n_words") * min_left)).drop(row, mark)


def remove_lines(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id", least: int = LEAST_DOCS, share: float = MAX_SHARE) -> DataFrame:
    """docs with the text's boilerplate lines taken out; other lines stay as they are, joined by line feeds again."""
    one, two = _digests(F.col(text))
    key = [F.col(doc_id).alias("id"), one.alias("digest"), two.alias("digest2"), F.col(host).alias("host"), line_list(F.col(text)).alias("lines")]
    documents = cut(_documents(docs.select(*key)))
    l, c = documents.select("digest", "digest2", "host", F.explode("lines.h").alias("h")).distinct().alias("l"), common_lines(documents, least, share).alias("c")
    hit = l.join(c, F.col("l.host").eqNullSafe(F.col("c.host")) & (F.col("l.h") == F.col("c.line")), "left_semi")
    # One text's own lines: bounded by the text.
    gone = hit.groupBy("digest", "digest2", "host").agg(F.collect_set("h").alias("gone"))
    mark, mine = hidden(docs, "_gone", "_mine")
    its, own = F.col(mark), F.col(mine)
    same = (own["digest"] == its["digest"]) & (own["digest2"] == its["digest2"]) & own["host"].eqNullSafe(its["host"])
    keyed = docs.withColumn(mine, F.struct(one.alias("digest"), two.alias("digest2"), F.col(host).alias("host")))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x: ~F.array_contains(its["gone"], F.xxhash64(normal_line(x))))
    out = keyed.join(gone.select(F.struct("*").alias(mark)), same, "left").withColumn(text, F.when(its.isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
