"""Queries over filters, access control, aggregates, windows, pages, sets, joins and the lifecycle of collections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.operators import filters as fl
from brindle.operators import graph as gr
from brindle.operators import lifecycle as lc
from brindle.operators import paging as pg
from brindle.operators import security as sec
from brindle.operators import usage as us
from brindle.plans.registry import Tables, query

# ---- filters and access --------------------------------------------------------------------------------------------------

_K = "(props::json->>'k')::double"


def _events_where(tree):
    return lambda t: t.events.where(fl.compile_filter(tree, F.col("props"))).select("event_id")


def _filter_query(name: str, tree: dict, where: str) -> None:
    fn = _events_where(tree)
    fn.__name__ = name
    query(f"select event_id from events where {where}")(fn)


_filter_query("filter_eq", {"k": 7}, f"{_K} = 7")
_filter_query("filter_eq_other_type", {"type": "eq", "key": "k", "value": "7"}, "false")
_filter_query("filter_in", {"type": "in", "key": "k", "value": [1, 2, 99]}, f"{_K} in (1, 2, 99)")
_filter_query("filter_ne", {"type": "ne", "key": "k", "value": 7}, f"{_K} is not null and {_K} <> 7")
_filter_query("filter_nin", {"type": "nin", "key": "k", "value": [1, 2]}, f"{_K} is not null and {_K} not in (1, 2)")
_filter_query("filter_range", {"type": "and", "filters": [{"type": "gte", "key": "k", "value": 10}, {"type": "lt", "key": "k", "value": 20.5}]}, f"{_K} >= 10 and {_K} < 20.5")
_filter_query("filter_range_other_type", {"type": "gt", "key": "k", "value": "1"}, "false")
_filter_query("filter_or", {"type": "or", "filters": [{"k": 3}, {"type": "in", "key": "k", "value": [4, 5]}]}, f"{_K} in (3, 4, 5)")
_filter_query("filter_missing_key", {"type": "ne", "key": "absent", "value": 1}, "false")


@query("select event_id from events where event_type = 'click' and (props::json->>'k')::double > 50 and user_id in (1, 2, 3)")
def filter_columns_and_attributes(t: Tables):
    tree = {"type": "and", "filters": [{"classification": "click"}, {"type": "gt", "key": "k", "value": 50}]}
    ok = fl.compile_filter(tree, F.col("props"), {"classification": F.col("event_type")})
    return t.events.where(ok & F.col("user_id").isin(1, 2, 3) & fl.optional_equals(F.col("user_id"), None)).select("event_id")


def _secured(t: Tables):
    n = F.col("o_orderkey")
    groups = F.when(n % 3 == 0, F.array(F.lit("g1"))).when(n % 3 == 1, F.array(F.lit("g2"), F.lit("g3"))).otherwise(F.array().cast("array<string>"))
    roles = F.when(n % 5 == 0, F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>"))
    return t.orders.select("o_orderkey", (n % 6).cast("int").alias("security_level"), groups.alias("groups"), roles.alias("roles"), F.lit("t").alias("tenant_id"), F.when(n % 2 == 0, "a").otherwise("b").alias("instance_id"), (n % 7 != 0).alias("active"))


@query("select o_orderkey from orders where o_orderkey % 6 <= 3 and o_orderkey % 3 <> 0 and o_orderkey % 5 <> 0")
def acl_filter(t: Tables):
    p = sec.Principal("t", "a", ("g2", "x"), (), 3)
    return _secured(t).where(sec.acl_allowed(F.col("security_level"), F.col("groups"), F.col("roles"), p)).select("o_orderkey")


@query("select o_orderkey from orders where o_orderkey % 2 = 0 and o_orderkey % 6 <= 3 and o_orderkey % 7 <> 0")
def tenant_scope(t: Tables):
    return sec.scoped(_secured(t), sec.Principal("t", "a", (), (), 3)).select("o_orderkey")


@query("select o_orderkey, 'court,' || case when o_orderkey % 2 = 0 then 'year' else 'year2' end as keys from orders")
def safe_attributes(t: Tables):
    extra = F.when(F.col("o_orderkey") % 2 == 0, "year").otherwise("year2")
    m = F.create_map(F.lit("court"), F.lit("x"), extra, F.lit("1"), F.lit("api_key"), F.lit("s"), F.lit("user.password"), F.lit("s"), F.lit("bad key"), F.lit("y"))
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(F.map_keys(sec.safe_attributes(m))), ",").alias("keys"))


# ---- aggregates ---------------------------------------------------------------------------------------------------------


@query("select o_custkey, count(*) filter (o_orderstatus = 'F') as n_f, count(*) filter (o_orderstatus = 'O') as n_o, count(*) filter (o_orderstatus = 'P') as n_p, count(*) as total from orders group by 1")
def status_counts(t: Tables):
    return us.status_counts(t.orders, ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("""with c as (select o_custkey, count(*) filter (o_orderstatus = 'P') as p, count(*) filter (o_orderstatus = 'F') as f, count(*) as n from orders group by 1)
select o_custkey, case when p > 0 then 'in_progress' when f = n then 'failed' else 'completed' end as status from c""")
def batch_states(t: Tables):
    c = us.status_counts(t.orders, ["o_custkey"], "o_orderstatus", ["F", "P"]).withColumnsRenamed({"n_p": "n_in_progress", "n_f": "n_failed"})
    return us.batch_state(c).select("o_custkey", "status")


def _usage(t: Tables):
    return t.events.withColumns({"quantity": F.when(F.col("event_type") != "error", F.lit(1)), "cost": F.when(F.col("event_type") == "purchase", F.round(F.col("value"), 2))})


@query("select user_id, count(*) as events, coalesce(sum(case when event_type <> 'error' then 1 end), 0)::bigint as quantity, round(sum(case when event_type = 'purchase' then round(value, 2) end), 2) as cost from events group by 1")
def usage_summary(t: Tables):
    return us.usage_summary(_usage(t), "user_id").withColumn("cost", F.round("cost", 2))


@query("select user_id, count(*) as events, coalesce(sum(case when event_type <> 'error' then 1 end), 0)::bigint as quantity, round(sum(case when event_type = 'purchase' then round(value, 2) end), 2) as cost from events where ts >= '2024-01-10' and ts < '2024-01-20' group by 1")
def usage_window(t: Tables):
    day = lambda d: F.to_timestamp(F.lit(d))
    return us.usage_summary(_usage(t), "user_id", day("2024-01-10"), day("2024-01-20")).withColumn("cost", F.round("cost", 2))


@query("select event_type, c_name, count(*) as n from events left join customer on user_id = c_custkey group by 1, 2")
def usage_with_names(t: Tables):
    return t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"), "left").groupBy("event_type", "c_name").agg(F.count(F.lit(1)).alias("n"))


@query("""select e.*, o.* from (select count(*) as events, count(distinct user_id) as users, count(*) filter (event_type = 'error') as errors, epoch(max(ts))::bigint as last_event_epoch, round(sum(value), 2) as value from events) e,
(select count(*) filter (o_orderstatus = 'O') as open_orders, epoch(min(case when o_orderstatus = 'O' then o_orderdate end))::bigint as oldest_open_epoch from orders) o""")
def gauges(t: Tables):
    return us.gauges(t.events, t.orders, 2)


@query("select source, sum(strlen(text))::bigint as bytes from documents group by 1")
def document_bytes(t: Tables):
    return us.document_bytes(t.documents, "source", "text")


@query("select count(distinct l_orderkey) as documents, count(*) as chunks from lineitem")
def graph_coverage(t: Tables):
    return gr.coverage(t.lineitem.withColumnRenamed("l_orderkey", "document_id"))


@query("select l_returnflag as type, count(*) as n from lineitem group by 1")
def type_histogram(t: Tables):
    return gr.histogram(t.lineitem.withColumnRenamed("l_returnflag", "type"))


@query("""with n as (select *, count(*) over (partition by lang, source, sha256(text)) as c from documents)
select lang, source, count(*) as files, sum(n_chars)::bigint as bytes, max(n_chars) as largest, count(*) filter (n_chars > 5000) as over, count(*) filter (c > 1) as repeated from n group by 1, 2""")
def manifest_inventory(t: Tables):
    return us.inventory(t.documents.withColumn("h", F.sha2("text", 256)), ["lang", "source"], "n_chars", "h", 5000)


@query("""with r as (select o_orderkey, o_orderstatus, (year(o_orderdate) // 5 * 5)::int as band, row_number() over (partition by o_orderstatus, year(o_orderdate) // 5 order by o_orderkey) = 1 as stratum_first from orders)
select o_orderkey, o_orderstatus, band, stratum_first from r order by stratum_first desc, o_orderkey limit 40""")
def stratified_pilot(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus", us.year_band(F.year("o_orderdate")).alias("band"))
    return pg.stratified_sample(rows, ["o_orderstatus", "band"], ["o_orderkey"], 40)


@query("select user_id, event_type, date_trunc('minute', ts) as minute, count(*) as n from events group by all having count(*) > 1")
def rate_breaches(t: Tables):
    return us.rate_breaches(t.events, "user_id", "event_type", 1)


@query("select o_orderpriority as embedding_profile_id, count(*) as n from orders where o_orderstatus <> 'F' group by 1 order by 2 desc, 1 limit 3")
def embedding_profiles(t: Tables):
    from brindle.operators.retrieval import embedding_profiles as profiles

    chunks = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id"))
    return profiles(chunks, t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("embedding_profile_id")), 3)


@query("""select p_partkey, case when p_size % 3 = 1 then round(p_partkey * 100 / 1e6 * 0.02, 10) end as cost, case p_size % 3 when 0 then 'unknown_model_profile' when 2 then 'cost_unavailable' end as reason,
    case when p_size % 6 >= 4 then 'bge_private' when p_size % 2 = 0 then 'own' else 'default' end as profile, case when p_size % 4 = 0 then 'disabled' when p_size % 2 = 1 then 'active' else 'fallback' end as state from part""")
def cost_and_routing(t: Tables):
    s = F.col("p_size")
    cost, why = us.embedding_cost(F.col("p_partkey") * 100, F.when(s % 3 == 1, F.lit(0.02)), s % 3 != 0)
    profile = us.embedding_profile(F.when(s % 2 == 0, "own"), s % 6, "bge_private", "default")
    state = us.endpoint_state(F.when(s % 4 == 0, "off").otherwise("enabled"), F.when(s % 2 == 1, "Healthy").otherwise("down"), F.lit(True))
    return t.part.select("p_partkey", cost.alias("cost"), why.alias("reason"), profile.alias("profile"), state.alias("state"))


@query("""with c(mode, position, profile, preferred, private, mock) as (values ('m', 0, 'a', true, false, false), ('m', 1, 'b', false, true, false), ('m', 2, 'c', false, true, true)),
s as (select p_partkey as request_id, p_size % 6 as level, c.*, (p_size % 6 < 4 or private) as allowed,
    (100 - 7.5 * position + case when preferred then 15 else 0 end + case when p_size % 6 >= 4 and private then 10 else 0 end - case when mock then 30 else 0 end - case when p_size % 6 < 4 or private then 0 else 100 end)::double as score from part, c)
select request_id, profile, allowed, score, row_number() over (partition by request_id order by allowed desc, score desc, position)::int as plan_rank from s""")
def ingestion_plan_scores(t: Tables):
    cand = t.spark.createDataFrame([("m", 0, "a", True, False, False), ("m", 1, "b", False, True, False), ("m", 2, "c", False, True, True)], "mode string, position int, profile string, preferred boolean, private boolean, mock boolean")
    req = t.part.select(F.col("p_partkey").alias("request_id"), F.lit("m").alias("mode"), (F.col("p_size") % 6).alias("level"))
    return us.ingestion_plan(req, cand).select("request_id", "profile", "allowed", "score", "plan_rank")


# ---- order and pages ----------------------------------------------------------------------------------------------------


@query("""with p as (select * from orders where (o_orderdate, o_orderkey) < (select (o_orderdate, o_orderkey) from orders where o_orderkey = 100) order by o_orderdate desc, o_orderkey desc limit 21)
select o_orderkey, o_orderdate, (select count(*) from p) > 20 as has_more from (select * from p order by o_orderdate desc, o_orderkey desc limit 20)""")
def keyset_page(t: Tables):
    at = pg.after_row(t.orders, "o_orderkey", 100, ["o_orderdate", "o_orderkey"])
    return pg.keyset_page(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20, at)


@query("select o_orderkey, o_orderdate, true as has_more from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 20")
def keyset_page_asc(t: Tables):
    return pg.keyset_page(t.orders.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 20, descending=False)


@query("select o_orderkey, true as has_more from orders order by o_totalprice desc, o_orderkey limit 10 offset 30")
def offset_page(t: Tables):
    page, more = pg.offset_page(t.orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], pg.decode_page(pg.encode_page(30)), 10)
    return page.select("o_orderkey", more.alias("has_more"))


@query("select c_custkey, row_number() over (order by c_acctbal, c_custkey) as place from customer")
def global_order(t: Tables):
    return pg.global_rank(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal", "c_custkey"], "place").select("c_custkey", "place")


@query("select conv_id, turn, (select count(*) from conversations where conv_id = 1 and turn > 0) > 1 as has_more from conversations where conv_id = 1 and turn > 0 order by turn limit 1")
def items_page(t: Tables):
    return pg.items_page(t.conversations.where("conv_id = 1").select("conv_id", "turn"), "turn", "turn", 1, after=0)


@query("select o_orderkey from orders order by md5(o_orderkey::varchar), o_orderkey limit 80")
def md5_sample(t: Tables):
    return pg.hash_sample(t.orders.select("o_orderkey"), "o_orderkey", 80)


@query("select o_orderkey as id from orders where o_orderstatus = 'O' and o_custkey % 4 < 3 order by o_orderpriority, o_orderdate, o_orderkey limit 5")
def queue_pick(t: Tables):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), (F.col("o_custkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"))
    return pg.queue_pick(jobs, 5).select("id")


# ---- joins --------------------------------------------------------------------------------------------------------------


@query("select c_custkey, o_orderkey from customer left join lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_orderdate desc, o_orderkey limit 1) on true")
def lateral_latest_order(t: Tables):
    latest = t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.col("o_orderdate"), -F.col("o_orderkey"))).alias("o_orderkey"))
    return t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("""with h as (select l_orderkey, l_linenumber from lineitem where l_quantity > 49), n as (select distinct c.l_orderkey, c.l_linenumber from h join lineitem c on c.l_orderkey = h.l_orderkey and c.l_linenumber between h.l_linenumber - 1 and h.l_linenumber + 1)
select * from n except select * from h""")
def neighbour_expand(t: Tables):
    from brindle.operators.context import neighbors

    c = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), "l_quantity")
    hits = c.where("l_quantity > 49").withColumns({"query_id": F.lit(1), "rank": F.col("chunk_id")})
    return neighbors(hits, c.drop("l_quantity"), 1, 1).select(F.col("document_id").alias("l_orderkey"), F.col("ordinal").alias("l_linenumber"))


@query("""with c as (select p_brand as d, p_partkey as id, string_split(p_type, ' ') as p from part), h as (select * from c where id % 40 = 0),
m as (select h.id as hit, c.id, row_number() over (partition by h.id order by c.id) as k from h join c on c.d = h.d and c.p[1:len(h.p) - 1] = h.p[1:len(h.p) - 1] where len(h.p) > 1 and c.id not in (select id from h))
select distinct id as chunk_id from m where k <= 5""")
def parent_section_expand(t: Tables):
    from brindle.operators.context import parent_sections

    c = t.part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("chunk_id"), F.col("p_partkey").alias("ordinal"), F.split("p_type", " ").alias("heading_path"))
    hits = c.where("chunk_id % 40 = 0").withColumns({"query_id": F.lit(1), "rank": F.col("chunk_id")})
    return parent_sections(hits, c.withColumnRenamed("heading_path", "hp").withColumnRenamed("hp", "heading_path"), 5).select("chunk_id")


@query("select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey) and not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus <> 'F')")
def fully_indexed(t: Tables):
    chunks = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return lc.fully_indexed(t.orders.select("o_orderkey"), chunks, "o_orderkey", F.col("l_linestatus") == "F")


@query("select o_orderkey as id from orders where not exists (select 1 from lineitem l where l.l_orderkey = o_orderkey and not exists (select 1 from part where p_partkey = l.l_partkey and p_size < 45))")
def relational_division(t: Tables):
    edges = t.orders.join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ev")), "o_orderkey", "left").select(F.col("o_orderkey").alias("id"), "ev")
    return gr.evidence_closed(edges, "ev", t.part.where("p_size < 45").withColumnRenamed("p_partkey", "k"), "k").select("id")


@query("select l.p_partkey as left_id, r.s_suppkey as right_id from part l join supplier r on l.p_size = r.s_suppkey or l.p_partkey = r.s_nationkey")
def match_any_key(t: Tables):
    l = t.part.select(F.col("p_partkey").alias("id"), "p_size", "p_partkey")
    r = t.supplier.select(F.col("s_suppkey").alias("id"), "s_suppkey", "s_nationkey")
    return gr.match_any(l, r, [("p_size", "s_suppkey"), ("p_partkey", "s_nationkey")])


@query("with b as (select unnest([{k: 1, n: 'ALGERIA'}, {k: 2, n: 'WRONG'}]) as b) select b.k::int as k, n_name is not null and n_name = b.n as bound from b left join nation on n_nationkey = b.k")
def inline_bindings(t: Tables):
    doc = t.spark.range(1).select(F.from_json(F.lit('[{"k": 1, "n": "ALGERIA"}, {"k": 2, "n": "WRONG"}]'), "array<struct<k:int,n:string>>").alias("a"))
    rows = doc.select(F.inline("a"))
    return rows.join(t.nation, F.col("k") == F.col("n_nationkey"), "left").select("k", (F.col("n_name").isNotNull() & (F.col("n_name") == F.col("n"))).alias("bound"))


@query("with a as (select [5, 3, 9, 3] as a), u as (select unnest(a) as k, generate_subscripts(a, 1) - 1 as place from a) select place::int as place, k::int as k, n_name from u join nation on n_nationkey = k")
def unnest_with_place(t: Tables):
    rows = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in (5, 3, 9, 3)])).alias("place", "k"))
    return rows.join(t.nation, F.col("k") == F.col("n_nationkey")).select("place", "k", "n_name")


@query("select page_id::bigint as page_id, case when page_id % 2 = 0 then 'not_fetched' else 'unexpected' end as gap from (select page_id from pages where page_id % 6 in (2, 4) or page_id % 6 in (1, 5))")
def url_reconcile(t: Tables):
    even, third = t.pages.where("page_id % 2 = 0 "), t.pages.where("page_id % 3 = 0 or page_id % 2 = 1 and page_id % 3 <> 0")
    return lc.url_gaps(even.select("page_id"), third.where("page_id % 2 = 1 and page_id % 3 <> 0 or page_id % 6 = 0").select("page_id"), "page_id")


@query("""with e as (select doc_id as span_id, doc_id, substr(text, 1, 40) as quote from documents), c as (select doc_id, 0 as k, substr(text, 1, 200) as text from documents union all select doc_id, 1, substr(text, 201) from documents),
h as (select span_id, k, count(*) over (partition by span_id) as n from e join c using (doc_id) where contains(text, quote)) select span_id, k::int as k from h where n = 1""")
def quote_binding(t: Tables):
    d = t.documents
    c = d.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("k"), F.substring("text", 1, 200).alias("text")).unionByName(d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("k"), F.substring(F.col("text"), F.lit(201), F.length("text")).alias("text")))
    c = c.withColumns({"page_start": F.lit(1), "page_end": F.lit(3)})
    e = d.select(F.col("doc_id").alias("span_id"), F.col("doc_id").alias("document_id"), F.lit(2).alias("page"), F.substring("text", 1, 40).alias("quote"))
    return gr.bind_quotes(e, c).select("span_id", "k")


# ---- windows ------------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n from lineitem) where n = 1")
def first_chunk_per_document(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey")).alias("f")).select("l_orderkey", "f.*")


@query("select l_partkey, l_returnflag, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey, l_returnflag order by l_quantity, l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def distinct_on(t: Tables):
    best = F.min(F.struct("l_quantity", "l_orderkey", "l_linenumber")).alias("b")
    return t.lineitem.groupBy("l_partkey", "l_returnflag").agg(best).select("l_partkey", "l_returnflag", "b.l_orderkey", "b.l_linenumber")


@query("""with r as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as rank from lineitem),
d as (select *, row_number() over (partition by l_suppkey, l_partkey order by rank) as depth, min(rank) over (partition by l_suppkey, l_partkey) as first from r)
select l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by depth, first)::int as rank from d""")
def document_diversify(t: Tables):
    from brindle.operators.retrieval import diversify

    r = t.lineitem.withColumn("rank", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")))
    return diversify(r, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "rank")


@query("""with r as (select l_orderkey, l_linenumber, case l_linenumber % 3 when 1 then 1 when 2 then 2 else 3 end as level from lineitem)
select l_orderkey, l_linenumber, level::int as level, (select max(p.l_linenumber) from r p where p.l_orderkey = r.l_orderkey and p.l_linenumber < r.l_linenumber and p.level < r.level) as parent_position from r""")
def manifest_parents(t: Tables):
    level = F.when(F.col("l_linenumber") % 3 == 1, 1).when(F.col("l_linenumber") % 3 == 2, 2).otherwise(3)
    return gr.manifest_parents(t.lineitem.select("l_orderkey", "l_linenumber", level.alias("level")), "l_orderkey", "l_linenumber", "level")


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1)::int as sequence_no from conversations")
def conversation_sequence(t: Tables):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select("conv_id", "turn", n.alias("sequence_no"))


# ---- lifecycle and sets -------------------------------------------------------------------------------------------------


@query("""with d as (select doc_id, source, min(doc_id) over w as original, count(*) over w as copies from documents window w as (partition by source, sha256(text))) select source, doc_id, original, copies from d where copies > 1 and doc_id <> original""")
def dedupe_exact(t: Tables):
    return lc.exact_duplicates(t.documents, ["source"], "text", "doc_id")


@query("""select o_orderkey, row_number() over w as version_number, lead(o_orderkey) over w as superseded_by, lead(o_orderkey) over w is null as is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def version_history(t: Tables):
    return lc.versions(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "version_number", "superseded_by", "is_current")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'remove' when o_orderkey % 3 = 1 then 'upsert' when o_orderkey % 2 = 0 then 'upsert' else 'noop' end as action from orders")
def reconcile_plan(t: Tables):
    o, k = t.orders, F.col("o_orderkey")
    want = o.where(k % 3 != 0).select("o_orderkey", F.col("o_orderstatus").alias("h"))
    have = o.where(k % 3 != 1).select("o_orderkey", F.when(k % 2 == 0, "changed").otherwise(F.col("o_orderstatus")).alias("h"))
    return lc.reconcile(want, have, "o_orderkey", "h").select("o_orderkey", "action")


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def upsert_latest(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return lc.latest(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "at").drop("at")


@query("select c_custkey, case when c_custkey % 2 = 0 then 'old' else 'new' end as state from customer")
def insert_if_absent(t: Tables):
    c = t.customer.select("c_custkey")
    return lc.insert_absent(c.where("c_custkey % 2 = 0").withColumn("state", F.lit("old")), c.withColumn("state", F.lit("new")), ["c_custkey"])


@query("select user_id, (count(*) + case when user_id < 5 then 10 else 0 end)::bigint as count from events group by user_id")
def counter_increment(t: Tables):
    old = t.events.where("user_id < 5").select("user_id").distinct().withColumn("count", F.lit(10).cast("long"))
    return lc.increment(old, t.events, ["user_id"])


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'resumed' else 'open' end as state from nation")
def guarded_resume(t: Tables):
    scope = F.when(F.col("n_nationkey") % 3 == 0, F.lit(None)).otherwise(F.col("n_regionkey"))
    old = t.nation.select("n_nationkey", scope.alias("scope"), F.lit("open").alias("state"))
    other = F.when(F.col("n_nationkey") % 2 == 0, scope).otherwise(F.lit(99))
    return lc.resume(old, t.nation.select("n_nationkey", other.alias("scope"), F.lit("resumed").alias("state")), "n_nationkey", ["scope"], ["state"]).select("n_nationkey", "state")


@query("select s_suppkey, s_acctbal >= 0 as active, case when s_acctbal < 0 then 'delete_queued' else 'ready' end as status from supplier")
def soft_delete(t: Tables):
    s = t.supplier.select("s_suppkey", "s_acctbal", F.lit(True).alias("active"), F.lit("ready").alias("status"))
    return lc.deactivate(s, F.col("s_acctbal") < 0).drop("s_acctbal")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then o_orderdate + interval 7 day end as expires_at from orders")
def expiry_policy(t: Tables):
    k = F.col("o_orderkey")
    days = F.when(k % 3 == 0, "7").when(k % 3 == 1, "-7").otherwise("x")
    return t.orders.select("o_orderkey", lc.expires_at(F.col("o_orderdate"), F.lit("last_active_at"), days).alias("expires_at"))


@query("select p_partkey from part where p_partkey % 5 = 0 or p_size > 40")
def stale_vectors(t: Tables):
    chunks = t.part.where("p_partkey % 5 <> 0").select("p_partkey", (F.col("p_size") <= 40).alias("active"))
    return lc.stale_vectors(t.part.select("p_partkey"), chunks, "p_partkey")


@query("select p_brand, count(*) as entries, count(distinct p_type) as p_type, count(distinct p_size) as p_size from part group by 1 having count(distinct p_type) > 1 or count(distinct p_size) > 1")
def harvest_conflicts(t: Tables):
    return lc.harvest_conflicts(t.part, "p_brand", ["p_type", "p_size"])


@query("""select o_orderkey, array_to_string(list_filter([case when not o_totalprice > 1000 then 'price' end, case when o_orderstatus = 'P' then 'status' end], lambda x: x is not null), ',') as failures,
    case when o_orderkey % 4 = 0 then 'tagged' when o_orderkey % 4 = 1 then 'plain' else 'invalid' end as branch from orders""")
def audit_and_dispatch(t: Tables):
    k = F.col("o_orderkey")
    rows = lc.audit_rows(t.orders, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"})
    return rows.select("o_orderkey", F.array_join("failures", ",").alias("failures"), lc.classify_record([k % 4 != 1, (k % 4 == 0) | (k % 4 == 3)]).alias("branch")).withColumn("branch", F.when(k % 4 == 3, "invalid").otherwise(F.col("branch")))


@query("select count(*) as pages, count(distinct url) as urls, case when count(*) = count(distinct url) then true else false end as passed, case when count(*) = count(distinct url) then '' else 'repeated urls' end as reasons from pages")
def quality_gate(t: Tables):
    c = t.pages.agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))
    return lc.quality_gate(c, {"repeated urls": F.col("pages") != F.col("urls"), "no pages": F.col("pages") == 0}).withColumn("reasons", F.array_join("reasons", ","))


@query("select text_key, doc_id, conflict from (select sha256(text) as text_key, doc_id, min(source) over w <> max(source) over w as conflict, row_number() over (partition by sha256(text) order by doc_id) as n from documents window w as (partition by sha256(text))) where n = 1")
def batch_merge(t: Tables):
    d = t.documents.select(F.sha2("text", 256).alias("text_key"), "doc_id", "source")
    return lc.merge_batches(d, "text_key", "doc_id", "source").select("text_key", "doc_id", "conflict")


@query("select o_custkey, max(o_orderkey) as o_orderkey from orders group by 1")
def newest_revisions(t: Tables):
    o = t.orders.select("o_custkey", "o_orderkey")
    return lc.newest_revisions(o.where("o_orderkey % 3 > 0"), o.where("o_orderkey % 3 = 0"), "o_custkey", "o_orderkey")
