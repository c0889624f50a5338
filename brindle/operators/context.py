"""What surrounds a hit: neighbours, parent sections, a packed context within a token budget, an extractive answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import text as tx

SEPARATOR = "\n\n---\n\n"


def neighbors(hits: DataFrame, chunks: DataFrame, before: int = 1, after: int = 1, doc: str = "document_id", ordinal: str = "ordinal") -> DataFrame:
    """Chunks around each hit in its document (J6, R12), each at its first hit only; hits themselves are left out.

    The range becomes an equality: every hit asks for its neighbours' ordinals.
    """
    steps = F.array(*[F.lit(i) for i in range(-before, after + 1) if i])
    asks = hits.select("query_id", "rank", doc, F.col("chunk_id").alias("hit_id"), F.explode(F.transform(steps, lambda s: F.col(ordinal) + s)).alias(ordinal))
    found = asks.join(chunks, [doc, ordinal])
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank", "hit_id"))
    out = found.withColumn("_n", first).where("_n = 1").drop("_n")
    return out.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("relation", F.lit("neighbor"))


def parent_sections(hits: DataFrame, chunks: DataFrame, most: int, doc: str = "document_id", path: str = "heading_path", ordinal: str = "ordinal") -> DataFrame:
    """Chunks under the heading above each hit's own (J7, R13), `most` for a hit, each at its first hit only."""
    depth = F.size(path) - 1
    asks = hits.where(F.size(path) > 1).select("query_id", "rank", doc, F.col("chunk_id").alias("hit_id"), F.slice(path, F.lit(1), depth).alias("_prefix"))
    found = asks.join(chunks, doc).where(F.slice(F.col(path), F.lit(1), F.size("_prefix")) == F.col("_prefix"))
    found = found.join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    per_hit = F.row_number().over(Window.partitionBy("query_id", "hit_id").orderBy(ordinal, "chunk_id"))
    found = found.withColumn("_k", per_hit).where(F.col("_k") <= most)
    first = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("rank", "hit_id"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n", "_k", "_prefix").withColumn("relation", F.lit("parent_section"))


def merge_expansions(hits: DataFrame, parents: DataFrame, near: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Each hit, then its parents, then its neighbours; a chunk at its first place only."""
    cols = ["query_id", "chunk_id", "text", "rank", "relation", ordinal]
    parts = [hits.withColumn("relation", F.lit("direct")).select(*cols), parents.select(*cols), near.select(*cols)]
    rows = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    direct = F.min(F.when(F.col("_p") == 0, F.col("rank"))).over(Window.partitionBy("query_id", "chunk_id"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy(F.when(direct.isNotNull() & (F.col("_p") == 0), 0).otherwise(1), "rank", "_p")))
    order = Window.partitionBy("query_id").orderBy("rank", "_p", ordinal, "chunk_id")
    return rows.where("_n = 1").withColumn("position", F.row_number().over(order)).drop("_n", "_p")


def pack(ranked: DataFrame, budget: int = 6000, by: str = "query_id", order: str = "rank", label: Column | None = None) -> DataFrame:
    """Rows that fit the token budget in order, up to the first that doesn't (W7), with where each begins in the joined text.

    Adds token_count, tokens_so_far, source_number, part (labelled text with its citation mark) and start.
    """
    w = Window.partitionBy(by).orderBy(order)
    rows = ranked.withColumn("token_count", tx.estimate_tokens(F.col("text")))
    rows = rows.withColumn("tokens_so_far", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("tokens_so_far") <= budget)
    rows = rows.withColumn("source_number", F.row_number().over(w))
    head = F.concat(F.lit("["), F.col("source_number").cast("string"), F.lit("] ")) if label is None else label
    rows = rows.withColumn("part", F.concat(head, F.col("text"), F.lit(" "), tx.citation_marker(F.col("source_number"))))
    before = F.coalesce(F.sum(F.length("part") + len(SEPARATOR)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", before)


def packed_text(packed: DataFrame, by: str = "query_id") -> DataFrame:
    """(query_id, context, sources, tokens): the joined context of each query."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("source_number", "part"))), lambda x: x["part"])
    return packed.groupBy(by).agg(F.array_join(parts, SEPARATOR).alias("context"), F.max("source_number").alias("sources"), F.max("tokens_so_far").alias("tokens"))


def answers(ranked: DataFrame, most: int = 5, length: int = 700) -> DataFrame:
    """(query_id, answer, citations): redacted snippets of the first rows, each with its mark and where the mark stands."""
    rows = ranked.where(F.col("rank") <= most).withColumn("_s", tx.snippet(tx.redact(F.col("text")), length)).where("_s <> ''")
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("mark", tx.citation_marker(F.col("n")))
    rows = rows.withColumn("piece", F.concat("_s", F.lit(" "), F.col("mark")))
    before = F.coalesce(F.sum(F.length("piece") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("index", before + F.length("_s") + 1)
    in_order = F.sort_array(F.collect_list(F.struct("n", "piece", "chunk_id", "index")))
    out = rows.groupBy("query_id").agg(in_order.alias("p"))
    return out.select("query_id", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("answer"), F.transform("p", lambda x: F.struct(x["n"].alias("source"), x["chunk_id"].alias("chunk_id"), x["index"].alias("index"))).alias("citations"))


def citations_whole(answer: Column, citations: Column) -> Column:
    """Every mark of the answer has a citation that stands where it says, and no other."""
    marks = F.regexp_count(answer, F.lit(tx.CITATION))
    right = F.forall(citations, lambda c: F.substring(answer, c["index"].cast("int") + 1, F.length(tx.citation_marker(c["source"]))) == tx.citation_marker(c["source"]))
    return (marks == F.size(citations)) & right


def fit_words(text: Column, used: Column, budget: int) -> Column:
    """The longest run of words from the start whose estimate, with what is used, keeps to the budget."""
    words = tx.words(text)
    most = F.greatest(F.lit(0), F.ceil((F.lit(budget) - used + 1) * 3 / 4).cast("int") - 1)
    return F.when(F.size(words) <= most, text).otherwise(F.array_join(F.slice(words, F.lit(1), most), " "))


def history_context(messages: DataFrame, tokens: int = 512, most: int = 4) -> DataFrame:
    """(conv_id, context): the last messages that fit a word budget, oldest first."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    rows = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= most)
    rows = rows.withColumn("_t", tx.estimate_tokens(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("_sum", F.sum("_t").over(back.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") <= tokens)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return rows.groupBy("conv_id").agg(F.array_join(parts, "\n").alias("context"), F.max("_sum").alias("tokens"))


def result_page(ranked: DataFrame) -> DataFrame:
    """Result objects of a page (R20): redacted text with its mark, attributes and a citation."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = ranked.withColumn("n", n)
    text = F.concat(tx.redact(F.col("text")), F.lit(" "), tx.citation_marker(F.col("n")))
    cited = F.struct(F.lit("file_citation").alias("type"), F.col("n").alias("index"), F.col("document_id").cast("string").alias("file_id"))
    return rows.select("query_id", "n", "chunk_id", "score", text.alias("text"), cited.alias("citation"))
