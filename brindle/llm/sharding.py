"""Sharding by balanced label propagation, under the law `rows`: the shards' row counts differ by one at most.

Documents of equal texts are linked. Each document begins in a shard that its id's hash gives. Then, round by round, the members of
every group look where most of the group is and ask to go there; a move is granted only against a move the other way, or against a
document without links, to which every shard is the same, so the counts stay what they must be. A group larger than a shard fills
one and goes on to the next; what smaller groups hold of a shard stays theirs. Rounds go on until nobody moves. They end: a move
takes rows of a group only to a shard that holds as many of the group at least, so the squares of all groups' counts by shard, and
with them the links inside shards, add up to more each round.

Members of a group are alike, so the rounds run on its counts by shard, (group, shard, count), and never on documents. What is granted
comes from a matrix of shards by shards, the only thing that is ever at the driver. At the end every document takes the place of
its rank in its group. Ranks and prefix sums are taken in BUCKETS hash buckets of a group or a shard and added up over these, so no
window holds a whole group or shard, and the documents themselves move once.

Cases: a null text has size 1, the checksum of the empty text and no links but to rows without a text under the same id; empty texts
are equal texts; repeated rows are separate rows and linked by their text; very long texts are hashed whole and only move with the
row in `with_shards`; an empty table gives an empty result; columns of the result's names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.session import cut, hidden

#: Parts in which the ranks of a group and the prefix sums of a shard are taken.
BUCKETS = 512


def text_key(text: Column, doc_id: Column) -> Column:
    """Equal for equal texts; a null text has a key by its id."""
    return F.when(text.isNotNull(), F.xxhash64(text, F.length(text), F.crc32(text.cast("binary")))).otherwise(F.xxhash64(F.lit("null"), doc_id))


def _with_sum_before(df: DataFrame, by: str, amount: str, out: str) -> DataFrame:
    """Adds the sum of `amount` over the rows before, of the same `by`, in the order of a hash of g."""
    rows = df.withColumn("_z", F.pmod(F.xxhash64("g", F.lit(5)), F.lit(BUCKETS)))
    parts = rows.groupBy(by, "_z").agg(F.sum(amount).alias("_t"))
    upto = Window.partitionBy(by).orderBy("_z").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(by, "_z", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_first"))
    inside = F.sum(amount).over(Window.partitionBy(by, "_z").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_in", inside).join(parts, [by, "_z"]).withColumn(out, F.col("_first") + F.coalesce("_in", F.lit(0))).drop("_z", "_in", "_first")


def _moved(cells: DataFrame, asked: DataFrame, grants: list[tuple[int, int, int, int]]) -> DataFrame:
    """cells (g, s, c) after rows of `asked` (g, s, k, c) have moved: of those of class k, places lo to hi - 1 go to shard t.

    grants: (k, t, lo, hi), at most shards x shards of them.
    """
    table = cells.sparkSession.createDataFrame(grants, "k int, t int, lo long, hi long")
    share = F.least(F.col("before") + F.col("c"), F.col("hi")) - F.greatest("before", "lo")
    moves = _with_sum_before(asked, "k", "c", "before").join(table, "k").withColumn("m", share).where("m > 0").select("g", "s", "t", "m")
    moves = cut(moves)
    parts = cells.unionByName(moves.select("g", "s", (-F.col("m")).alias("c"))).unionByName(moves.select("g", F.col("t").alias("s"), F.col("m").alias("c")))
    return cut(parts.groupBy("g", "s").agg(F.sum("c").alias("c")).where("c > 0"))


def _evened(cells: DataFrame, room: list[int]) -> DataFrame:
    """cells whose counts leave no shard over its size: room is what each shard has left, less than nothing where it is over."""
    open_ = [[t, r] for t, r in enumerate(room) if r > 0]
    grants = []
    for s, r in enumerate(room):
        at = 0
        while at < -r:
            t, left = open_[-1]
            take = min(left, -r - at)
            grants.append((s, t, at, at + take))
            at, open_[-1][1] = at + take, left - take
            if left == take:
                open_.pop()
    return _moved(cells, cells.withColumn("k", F.col("s")), grants) if grants else cells


def granted(wants: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Moves by (from, to) that leave every shard's count as it is: against moves the other way, then against rows without links."""
    moves = {k: min(v, wants.get((k[1], k[0]), 0)) for k, v in wants.items()}
    room = list(room)
    for (s, t), v in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        if (more := min(v - moves[s, t], room[t])) > 0:
            moves[s, t] += more
            room[t] -= more
            room[s] += more
    return {k: v for k, v in moves.items() if v}


def _round(cells: DataFrame, room: list[int], n: int) -> DataFrame | None:
    """One round of propagation over (g, s, c); None if nobody moves."""
    # Where a group is most, among the shards with room: those that still hold rows without links.
    open_ = F.when(F.get(F.array(*[F.lit(r > 0) for r in room]), F.col("s")), F.col("c")).otherwise(0)
    spot = F.max(F.struct(open_.alias("open"), F.col("c"), F.xxhash64("g", "s").alias("tie"), F.col("s"))).alias("m")
    aim = cells.groupBy("g").agg(spot).select("g", F.col("m.s").alias("t"), F.col("m.c").alias("most"))
    asked = cells.join(aim, "g").where("s <> t and c <= most").select("g", "s", (F.col("s") * n + F.col("t")).alias("k"), "c")
    asked = cut(asked)
    wants = {(r["k"] // n, r["k"] % n): r["c"] for r in asked.groupBy("k").agg(F.sum("c").alias("c")).collect()}  # n x n at most
    moves = granted(wants, room)
    return _moved(cells, asked, [(s * n + t, t, 0, q) for (s, t), q in moves.items()]) if moves else None


def cut_links(cells: DataFrame) -> tuple[int, int]:
    """Links between members of one group, and how many of them go from one shard to another."""
    pairs = F.col("c") * (F.col("c") - 1) / 2
    inside = cells.agg(F.sum(pairs)).first()[0] or 0
    every = cells.groupBy("g").agg(F.sum("c").alias("c")).agg(F.sum(pairs)).first()[0] or 0
    return int(every), int(every - inside)


def propagate(cells: DataFrame, sizes: list[int]) -> DataFrame:
    """cells (g, s, c) of linked groups after all rounds, in shards of the given sizes."""
    n = len(sizes)

    def room(of: DataFrame) -> list[int]:
        held = {r["s"]: r["c"] for r in of.groupBy("s").agg(F.sum("c").alias("c")).collect()}
        return [sizes[s] - held.get(s, 0) for s in range(n)]

    cells = _evened(cells, room(cells))
    while (moved := _round(cells, room(cells), n)) is not None:
        cells = moved
    return cells


def _places(keys: DataFrame, n: int) -> DataFrame:
    """(g, b, base, spans): for the members of group g in bucket b the rank of the first, and which ranks go to which shard and slot.

    keys: (g, b, s, n), the members by bucket and by shard of beginning.
    """
    sizes = keys.groupBy("g").agg(F.sum("n").alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    each = [total // n + (s < total % n) for s in range(n)]
    linked = cut(sizes.where("m > 1").select("g"))
    own = keys.join(linked, "g", "left_semi")
    cells = propagate(cut(own.groupBy("g", "s").agg(F.sum("n").alias("c"))), each)
    held = {r["s"]: r["c"] for r in cells.groupBy("s").agg(F.sum("c").alias("c")).collect()}
    free = [each[s] - held.get(s, 0) for s in range(n)]
    # Rows without links take a shard's first slots, its groups follow one after another.
    start = F.get(F.array(*[F.lit(x).cast("long") for x in free]), F.col("s"))
    at = _with_sum_before(cells, "s", "c", "_at").withColumn("slot", start + F.col("_at"))
    upto = Window.partitionBy("g").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard at most
    at = at.withColumn("lo", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    span = F.struct("lo", (F.col("lo") + F.col("c")).alias("hi"), F.col("s").alias("shard"), "slot")
    spans = at.groupBy("g").agg(F.collect_list(span).alias("spans"))
    parts = own.groupBy("g", "b").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows at most
    groups = parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).join(spans, "g").select("g", "b", "base", "spans")
    single = _with_sum_before(keys.join(linked, "g", "left_anti").withColumn("one", F.lit(0)), "one", "n", "r")
    starts = [0]
    for k in free:
        starts.append(starts[-1] + k)
    whole = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    shard = F.size(F.filter(whole(starts[1:-1]), lambda x: x <= F.col("r"))) if n > 1 else F.lit(0)
    one = F.struct(F.lit(0).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi"), shard.alias("shard"), (F.col("r") - F.get(whole(starts), shard)).alias("slot"))
    return groups.unionByName(single.select("g", "b", F.lit(0).cast("long").alias("base"), F.array(one).alias("spans")))


def _sharded(docs: DataFrame, n: int, doc_id: str, text: str, row: str) -> DataFrame:
    """docs, whose column `row` holds what is to be kept of a row as a struct, to row, shard and slot."""
    order = F.xxhash64(F.col(doc_id), F.lit(17))
    rows = docs.select(
        row, text_key(F.col(text), F.col(doc_id)).alias("g"), order.alias("o"), F.pmod(F.xxhash64(order), F.lit(BUCKETS)).cast("int").alias("b"),
        F.pmod(F.xxhash64(order, F.lit(3)), F.lit(n)).cast("int").alias("s"), F.col(doc_id).alias("id"),
    )
    places = _places(cut(rows.groupBy("g", "b", "s").agg(F.count(F.lit(1)).alias("n"))), n)
    ranked = rows.drop("s").withColumn("_r", F.row_number().over(Window.partitionBy("g", "b").orderBy("o", "id")) - 1)
    at = F.col("_r") + F.col("base")
    found = ranked.join(cut(places), ["g", "b"]).withColumn("at", at)
    found = found.withColumn("span", F.get(F.filter("spans", lambda x: (x["lo"] <= F.col("at")) & (F.col("at") < x["hi"])), F.lit(0)))
    return found.select(row, F.col("span.shard").alias("shard"), (F.col("span.slot") + F.col("at") - F.col("span.lo")).alias("slot"))


def assign_shards(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless in the shard)."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = F.struct(F.col(doc_id).alias("id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"))
    out = _sharded(docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), kept.alias("_row")), n_shards, "_id", "_text", "_row")
    return out.select(F.col("_row.id").alias(doc_id), F.col("_row.size").alias("size"), F.col("_row.crc").alias("text_crc32"), "shard", "slot")


def with_shards(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard and slot; all other columns stay as they are."""
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    id_, body, row = hidden(docs, "_id", "_text", "_row")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep])
    out = _sharded(docs.select(F.col(doc_id).alias(id_), F.col(text).alias(body), kept.alias(row)), n_shards, id_, body, row)
    return out.select(*[F.col(row)[c].alias(c) for c in keep], "shard", "slot")
