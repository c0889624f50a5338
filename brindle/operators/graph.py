"""Property graphs as two tables: nodes (id, type, label, properties map) and edges (id, type, source, target, properties map)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import text as tx
from brindle.functions.hashing import stable_id
from brindle.lineage import cut

# What is looked for in a decision's text (kind, pattern, group of the key).
SIGNALS = (
    ("case_citation", r"([A-Z][\w.&' ]{1,60} v\. [A-Z][\w.&' ]{1,60}), \d+ (?:Kan\.|P\.\d?d?|U\.S\.)", 1),
    ("statute", r"K\.S\.A\.\s*(?:\d{4}\s*Supp\.\s*)?(\d+[a-z]?\s*-\s*[\d,a-z]+)", 1),
    ("rule", r"(?:Supreme Court )?Rule (\d+(?:\.\d+)?)", 1),
    ("docket", r"No\. ?(\d{2,3},?\d{3})", 1),
)


def signals(records: DataFrame, text: str = "text") -> DataFrame:
    """records with one row for each citation, statute, rule and docket in the text: kind, key."""
    def of(kind: str, pattern: str, group: int) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("key")))

    found = [of(*s) for s in SIGNALS]
    rows = records.withColumn("_s", F.explode(F.flatten(F.array(*found))))
    key = F.when(F.col("_s.kind") == "case_citation", tx.case_name(F.col("_s.key"))).when(F.col("_s.kind") == "docket", tx.digits(F.col("_s.key"))).otherwise(tx.section_number(F.col("_s.key")))
    return rows.withColumn("kind", F.col("_s.kind")).withColumn("key", key).drop("_s")


def merge_nodes(nodes: DataFrame, order: str) -> DataFrame:
    """One node an id: the first row's type and label, properties of which later rows win by key (G1, U4); `section` stays."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "type", "label", "properties")), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    out = nodes.groupBy("id").agg(rows.alias("r"))
    kind = F.when(F.exists("r", lambda x: x["type"] == "section"), F.lit("section")).otherwise(F.get("r", 0)["type"])
    entries = F.flatten(F.transform("r", lambda x: F.map_entries(x["properties"])))
    return out.select("id", kind.alias("type"), F.get("r", 0)["label"].alias("label"), F.map_from_entries(entries).alias("properties"), F.size("r").alias("merged"))


def merge_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge a key: source, target, type, and the properties unless it is CONTAINS."""
    props = F.when(F.col("type") == "CONTAINS", F.lit("")).otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("properties")))))
    w = Window.partitionBy("source", "target", "type", props).orderBy(order)
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def decision_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of decisions (document_id, title, docket_number, court, decision_year, status, text) (G1).

    What decisions are linked to is one table (opinion, kind, relation, key), from one reading of the texts; nodes and edges follow from it.
    """
    r = records.withColumn("opinion", stable_id("opinion", F.col("document_id")))
    linked = {"docket": "docket_number", "court": "court", "year": "decision_year", "status": "status"}
    item = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.lit(f"HAS_{kind.upper()}").alias("relation"), key.cast("string").alias("key"))
    known = F.filter(F.array(*[item(kind, F.col(c)) for kind, c in linked.items()]), lambda x: x["key"].isNotNull())
    parties = F.transform(tx.case_parties(F.col("title")), lambda p: item("party", p))
    own = r.select("opinion", F.explode(F.concat(known, F.coalesce(parties, F.array().cast("array<struct<kind:string,relation:string,key:string>>")))).alias("i")).select("opinion", "i.*")
    found = signals(r.select("opinion", "text")).select("opinion", "kind", F.concat(F.lit("CITES_"), F.upper("kind")).alias("relation"), "key")
    items = cut(own.unionByName(found)).withColumn("target", F.concat("kind", stable_id("", F.col("key"))))
    nodes = r.select(F.col("opinion").alias("id"), F.lit("opinion").alias("type"), F.col("title").alias("label"))
    nodes = nodes.unionByName(items.select(F.col("target").alias("id"), F.col("kind").alias("type"), F.col("key").alias("label")))
    edges = items.select(stable_id("edge", F.col("relation"), F.col("opinion"), F.col("target")).alias("id"), F.col("relation").alias("type"), F.col("opinion").alias("source"), "target")
    return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["id"])


def pair_edges(members: DataFrame, group: str, member: str, most: int | None = None) -> DataFrame:
    """Pairs of members of one group (G2). With `most`, of a group's first members only, which bounds a group's pairs.

    All pairs of a group are the operator's result, so it grows with the square of a group; give `most` where groups can be large.
    """
    once = members.select(group, member).distinct()
    if most is not None:
        once = once.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(member))).where(F.col("_n") <= most).drop("_n")
    l, r = once.withColumnRenamed(member, "source"), once.withColumnRenamed(member, "target")
    return l.join(r, group).where("source < target")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that isn't a node (G3), and which."""
    ids = nodes.select("id").distinct()
    bad = lambda end: edges.join(ids, edges[end] == ids["id"], "left_anti").withColumn("missing", F.lit(end))
    return bad("source").unionByName(bad("target"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows and the old ones that none replaces (K4, K7's rewrite)."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def histogram(df: DataFrame, column: str = "type") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coverage(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: near, far, direction (J11): an OR-join as two equalities."""
    seen = lambda a, b, d: edges.withColumns({"near": F.col(a), "far": F.col(b), "direction": F.lit(d)})
    return seen("source", "target", "out").unionByName(seen("target", "source", "in"))


def expand(seeds: DataFrame, edges: DataFrame, relations: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """One hop from seeds (id, rank): the best edge to each far node by relation (G11, G12, W3), far ends that are seeds left out."""
    rows = both_ways(edges if relations is None else edges.where(F.col("type").isin(relations))).withColumnRenamed("id", "edge_id")
    hop = rows.join(seeds.withColumnRenamed("id", "near"), "near").join(seeds.select(F.col("id").alias("far")), "far", "left_anti")
    w = Window.partitionBy("far", "type").orderBy("rank", "edge_id")
    best = hop.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return best if limit is None else best.orderBy("rank", "edge_id").limit(limit)


def evidence_closed(edges: DataFrame, evidence: str, resolved: DataFrame, key: str) -> DataFrame:
    """Edges all of whose evidence ids resolve (J10): ids that don't, then the edges that have none of them."""
    ids = edges.select("id", F.explode(evidence).alias(key))
    open_ = ids.join(resolved.select(key), key, "left_anti").select("id").distinct()
    return edges.join(open_, "id", "left_anti")


def two_hop(seeds: DataFrame, edges: DataFrame, through: str, kind: str) -> DataFrame:
    """Documents that share a node of an edge type with a seed."""
    e = edges.where(F.col("type") == through)
    shared = seeds.join(e.select(F.col("source").alias("id"), F.col("target").alias("via")), "id")
    other = e.select(F.col("source").alias("related"), F.col("target").alias("via"))
    return shared.join(other, "via").where("related <> id").select("id", "rank", "via", "related", F.lit(kind).alias("relation"))


def descendants(seeds: DataFrame, edges: DataFrame, depth: int = 4, kind: str = "CONTAINS") -> DataFrame:
    """(seed, id, distance): nodes below the seeds up to a depth, each at its least distance.

    One join a level over nodes not seen yet, so cycles end by themselves; each level is a table of its own, so a plan holds one.
    """
    down = edges.where(F.col("type") == kind).select(F.col("source").alias("id"), F.col("target").alias("next"))
    front = seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance")).distinct())
    for d in range(1, depth + 1):
        step = front.join(down, "id").select("seed", F.col("next").alias("id")).distinct()
        front = cut(step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front)) if d % 8 == 0 else seen.unionByName(front)
    return seen.where("distance > 0")


def ancestors(nodes: DataFrame, parents: DataFrame, depth: int = 16) -> DataFrame:
    """(id, ancestor, distance) up to a depth, each at its least distance (G19, G22); parents has (id, parent).

    By doubling: what is known up to distance n, extended from where it ends by all that is known from there, reaches 2n. So a
    depth of 200 takes eight rounds, cycles and repeated paths cost nothing, and each round is a table.
    """
    known = cut(parents.where("id <> parent").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    reach = 1
    while reach < depth:
        ends = known.where(F.col("distance") == reach)
        on = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("further"), F.col("distance").alias("more"))
        longer = ends.join(on, "ancestor").select("id", F.col("further").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        longer = longer.where((F.col("distance") <= depth) & (F.col("id") != F.col("ancestor"))).groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
        new = cut(longer.join(known.select("id", "ancestor"), ["id", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        known, reach = cut(known.unionByName(new)), 2 * reach
    return known.join(nodes.select("id").distinct(), "id", "left_semi").select("id", "ancestor", "distance")


def nearest_of_type(closure: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(id, ancestor): each node's nearest ancestor of a type."""
    ok = closure.join(nodes.where(F.col("type") == kind).select(F.col("id").alias("ancestor")), "ancestor")
    return ok.groupBy("id").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("ancestor"))


def subtree_hashes(components: DataFrame, levels: int | None = None) -> DataFrame:
    """(id, hash) over (id, parent, ordinal, content, level): a node's digest covers its content and its children's digests in order.

    By rounds from the lowest level up, which the table itself tells, so that trees of any depth are whole. `levels`, where given, is a
    contract: a deeper tree is refused. Children of equal ordinal are told apart by id; a null content is an empty one.
    """
    deepest = components.agg(F.max("level")).first()[0]
    if levels is not None and deepest is not None and deepest >= levels:
        raise ValueError(f"the tree has {deepest + 1} levels, {levels} were said")
    return _hash_levels(components, components.select("id", "parent", "ordinal").limit(0).withColumn("hash", F.lit("")), deepest)


def rehash(components: DataFrame, old: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, hash) of the nodes whose digest a change can touch: those of `changed` (id) and all above them, no others.

    components: the tree as it is now; old: (id, hash) from before. A node that was added, or lost a child, belongs to `changed`.
    """
    up = components.select("id", "parent")
    front = cut(changed.select("id").distinct().join(components.select("id"), "id", "left_semi"))
    touched = front
    while not front.isEmpty():
        above = front.join(up, "id").where(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
        front = cut(above.join(touched, "id", "left_anti"))
        touched = cut(touched.unionByName(front))
    own = cut(components.join(touched, "id", "left_semi"))
    beside = components.join(own.select(F.col("id").alias("parent")), "parent", "left_semi").join(touched, "id", "left_anti")
    known = cut(beside.join(old, "id").select("id", "parent", "ordinal", "hash"))
    return _hash_levels(own, known, own.agg(F.max("level")).first()[0])


def _hash_levels(components: DataFrame, known: DataFrame, deepest: int | None) -> DataFrame:
    """Digests of components, level by level; known (id, parent, ordinal, hash) are children that aren't hashed again.

    Components are written once, by level in each file, so that a level reads its own rows; each level is a table, read by the next and
    by the result.
    """
    components = cut(components.select("id", "parent", "ordinal", "content", "level").sortWithinPartitions("level"))
    own = F.sha2(F.coalesce("content", F.lit("")), 256)
    front, done = known.limit(0), []
    for d in range(-1 if deepest is None else deepest, -1, -1):
        here = components.where(F.col("level") == d)
        kids = front.unionByName(known.join(here.select(F.col("id").alias("parent")), "parent", "left_semi").select(*front.columns))
        below = kids.groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "id", "hash"))), lambda x: x["hash"]), "").alias("kids"))
        front = here.join(below, "id", "left").select("id", "parent", "ordinal", F.sha2(F.concat(own, F.coalesce("kids", F.lit(""))), 256).alias("hash"))
        done.append(front := cut(front))
    return reduce(DataFrame.unionByName, [f.select("id", "hash") for f in done]) if done else known.select("id", "hash").limit(0)


def interleave(hits: DataFrame, added: DataFrame) -> DataFrame:
    """The first hit, what the graph added, the other hits."""
    rows = hits.withColumn("_p", F.when(F.col("rank") == 1, 0).otherwise(2)).unionByName(added.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "rank"))).drop("_p")


def first_chunk(related: DataFrame, chunks: DataFrame, base: float = 0.66, doc: str = "document_id", ordinal: str = "ordinal") -> DataFrame:
    """The first chunk of each related document, scored base - 0.01 a rank."""
    first = Window.partitionBy(doc).orderBy(ordinal)
    heads = chunks.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return related.join(heads, doc).withColumn("score", F.round(F.lit(base) - 0.01 * F.col("rank"), 4))


def match_any(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Pairs (left id, right id) equal in one of several key pairs (J14): a union of equalities, not a nested loop."""
    parts = [
        left.select(F.col("id").alias("left_id"), F.col(a).cast("string").alias("k")).join(right.select(F.col("id").alias("right_id"), F.col(b).cast("string").alias("k")), "k")
        for a, b in keys
    ]
    return reduce(DataFrame.unionByName, [p.select("left_id", "right_id") for p in parts]).distinct()


def resolve_references(sections: DataFrame, nodes: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """(source, key, target, resolved): references that a text makes, with the node of that label if there is one."""
    refs = sections.select(F.col("id").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("key"))
    named = nodes.select(F.col("id").alias("target"), F.col("label").alias("key"))
    return refs.join(named, "key", "left").withColumn("resolved", F.col("target").isNotNull())


def ordinance_edges(ordinances: DataFrame, history: DataFrame) -> DataFrame:
    """Edges from ordinances (number, id, text) to the sections whose history names their number."""
    rows = history.join(ordinances, "number")
    kind = tx.ordinance_relation(F.col("text"))
    return rows.select(stable_id("edge", F.col("id"), F.col("section_id"), kind).alias("id"), kind.alias("type"), F.col("id").alias("source"), F.col("section_id").alias("target"))


def manifest_parents(rows: DataFrame, group: str, position: str, level: str) -> DataFrame:
    """Adds parent_position: the nearest row before it of a higher rank (W12), whatever the number of levels.

    A row speaks to every lower rank that its group has, and asks at its own: one window over (group, rank).
    """
    ranks = rows.groupBy(F.col(group).alias("_g")).agg(F.array_distinct(F.collect_set(level)).alias("_ranks"))  # levels of a group
    mine = F.filter("_ranks", lambda k: k >= F.col(level))
    spread = rows.join(ranks, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    spread = spread.withColumn("_rank", F.explode_outer(mine)).drop("_ranks")
    before = Window.partitionBy(group, "_rank").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    above = F.last(F.when(F.col(level) < F.col("_rank"), F.col(position)), ignorenulls=True).over(before)
    return spread.withColumn("parent_position", above).where(F.col("_rank").eqNullSafe(F.col(level))).drop("_rank")


def violations(nodes: DataFrame, edges: DataFrame, node_types: list[str], edge_types: list[str], max_nodes: int, max_edges: int) -> DataFrame:
    """(rule, id) for what breaks a graph's contract (G13): types, duplicates, dangling ends, self loops, size."""
    bad = lambda df, rule: df.select(F.lit(rule).alias("rule"), F.col("id").cast("string").alias("id"))
    twice = lambda df: df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    size = lambda df, most, rule: df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.lit(rule).alias("rule"), F.col("n").cast("string").alias("id"))
    parts = [
        bad(nodes.where(~F.col("type").isin(node_types)), "node type"), bad(edges.where(~F.col("type").isin(edge_types)), "edge type"),
        bad(twice(nodes), "duplicate node"), bad(twice(edges), "duplicate edge"), bad(dangling_edges(nodes, edges), "dangling edge"),
        bad(edges.where("source = target"), "self loop"), size(nodes, max_nodes, "too many nodes"), size(edges, max_edges, "too many edges"),
    ]
    return reduce(DataFrame.unionByName, parts)


def generation_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that only one of two loads of a run has (G14); a run may be loaded again only if there are none."""
    cols = sorted(set(old.columns) & set(new.columns))
    return old.select(*cols).exceptAll(new.select(*cols)).unionByName(new.select(*cols).exceptAll(old.select(*cols)))


def partition_digest(row_id: Column) -> Column:
    """An aggregate that doesn't depend on the order: the sums of two 32-bit parts of each id's SHA-256, so no list of ids is held."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(row_id, 256), at, 8), 16, 10).cast("long"))
    return F.concat_ws("-", part(1), part(9))


def manifest_mismatches(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Partitions whose rows differ from the manifest in number or digest (G15): manifest (partition, n, digest), rows (partition, id)."""
    have = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("have_n"), partition_digest(F.col("id")).alias("have_digest"))
    return manifest.join(have, "partition", "full").where(~(F.col("n").eqNullSafe(F.col("have_n")) & F.col("digest").eqNullSafe(F.col("have_digest"))))


def bind_quotes(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence (span_id, document_id, page, quote) with its chunk where exactly one chunk of the page range holds it."""
    hit = evidence.join(chunks, "document_id").where("page between page_start and page_end").where(F.contains("text", "quote"))
    n = F.count(F.lit(1)).over(Window.partitionBy("span_id"))
    return hit.withColumn("_n", n).where("_n = 1").drop("_n")
