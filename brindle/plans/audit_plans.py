"""Queries over evidence, gates, summaries, expansions and the stored search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.functions import text as tx
from brindle.lineage import cut, new_folder
from brindle.operators import code_pages as cp
from brindle.operators import evaluation as ev
from brindle.operators import evidence as ed
from brindle.operators import graph as gr
from brindle.operators import ingest as ig
from brindle.operators import lifecycle as lc
from brindle.operators import retrieval as rt
from brindle.operators.security import Principal
from brindle.plans.registry import Tables, query

# ---- measures of an extraction, evidence ----------------------------------------------------------------------------------


@query("""with d as (select doc_id, '<!-- page: 1 -->' || chr(10) || coalesce(replace(text, '|', ' '), '') || chr(10) || chr(10) || 'k | v' || chr(10) || '---|---' || chr(10) || doc_id || ' | x' || chr(10) || chr(10)
    || case when doc_id % 2 = 0 then '<!-- page: 2 -->' else '{4}' || repeat('-', 48) end || chr(10) || 'end' as t from documents)
select doc_id, length(t)::int as chars, sha256(t) as sha256, 1 as tables, 2 as table_rows, 4 as table_cells, 2 as page_marks, 1 as first_page, case when doc_id % 2 = 0 then 2 else 4 end as last_page, doc_id % 2 = 0 as pages_complete from d""")
def markdown_quality(t: Tables):
    nl = F.lit("\n")
    mark = F.when(F.col("doc_id") % 2 == 0, "<!-- page: 2 -->").otherwise("{4}" + "-" * 48)
    body = F.concat(F.lit("<!-- page: 1 -->\n"), F.coalesce(F.replace("text", F.lit("|"), F.lit(" ")), F.lit("")), F.lit("\n\nk | v\n---|---\n"), F.col("doc_id").cast("string"), F.lit(" | x\n\n"), mark, nl, F.lit("end"))
    return ed.markdown_quality(t.documents.select("doc_id", body.alias("text"))).drop("text")


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else '_' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') end as suffix from part")
def index_versions(t: Tables):
    return t.part.select("p_partkey", ed.index_version_suffix(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(" "), "p_type", F.lit("!")))).alias("suffix"))


_PAGED = r"""d as (select doc_id, coalesce(replace(replace(text, chr(13), ' '), '<!--', ' '), '') as t from documents), p as (select doc_id, '<!-- page 1 -->' || chr(10) || 'first' || chr(10) || t || chr(10) as a, 'second ' || doc_id || ' é' as q from d)"""


@query(f"""with {_PAGED} select doc_id, case when doc_id % 7 = 3 then 'quote' when doc_id % 7 = 5 then 'bounds' end as failure,
    case when doc_id % 7 not in (3, 5) then (length(a) + 16)::int end as char_start, case when doc_id % 7 not in (3, 5) then (length(a) + 16 + length(q))::int end as char_end,
    case when doc_id % 7 not in (3, 5) then (strlen(a) + 16)::int end as byte_start, case when doc_id % 7 not in (3, 5) then (strlen(a) + 16 + strlen(q))::int end as byte_end,
    case when doc_id % 7 not in (3, 5) then case when doc_id % 2 = 0 then 16 else 0 end end::int as page_char_start from p""")
def page_line_evidence(t: Tables):
    own = F.coalesce(F.replace(F.replace("text", F.lit("\r"), F.lit(" ")), F.lit("<!--"), F.lit(" ")), F.lit(""))
    quote = F.concat(F.lit("second "), F.col("doc_id").cast("string"), F.lit(" é"))
    k, line = F.col("doc_id") % 7, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    c = t.documents.select("doc_id", F.concat(F.lit("<!-- page 1 -->\nfirst\n"), own, F.lit("\n<!-- page 2 -->\n"), quote, F.lit("\nend\n")).alias("text"), quote.alias("quote"))
    c = c.withColumns(
        {
            "text_sha256": F.sha2("text", 256), "page_count": F.lit(2), "page": F.when(k == 5, 3).otherwise(2), "line_start": line, "line_end": line, "marker_is_line_one": F.col("doc_id") % 2 == 0,
            "quote_sha256": F.sha2("quote", 256), "quote": F.when(k == 3, F.concat("quote", F.lit("?"))).otherwise(F.col("quote")),
        }
    )
    return ed.page_lines(c).select("doc_id", "failure", "char_start", "char_end", "byte_start", "byte_end", "page_char_start")


@query("""select n_regionkey as source_id, r::int as record, case when n_regionkey = 2 then 'digest of record 1' when n_regionkey = 3 then 'source digest' end as failure, case when n_regionkey not in (2, 3) then (2 * r + 1)::int end as line_end
from (select n_regionkey, unnest(range(1, count(*) + 1)) as r from nation group by 1)""")
def csv_evidence(t: Tables):
    n = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rows = t.nation.withColumn("record", n)
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('\nx"\n'))
    content = F.encode(F.concat(F.lit("key,name\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("record", line.alias("l")))), lambda x: x["l"]), "")), "UTF-8")
    files = rows.groupBy(F.col("n_regionkey").alias("source_id")).agg(content.alias("content"))
    files = files.withColumn("sha256", F.when(F.col("source_id") == 3, "0").otherwise(F.sha2("content", 256)))
    value = F.concat(F.lit('{"headers":["key","name"],"values":["'), F.col("n_nationkey").cast("string"), F.lit('","'), "n_name", F.lit('\\nx"]}'))
    refs = rows.select(F.col("n_regionkey").alias("source_id"), "record", F.when((F.col("n_regionkey") == 2) & (F.col("record") == 1), "1").otherwise(F.sha2(value, 256)).alias("record_sha256"))
    return ed.csv_records(files, refs)


# ---- gates and summaries --------------------------------------------------------------------------------------------------


@query("""select o_custkey as batch, count(*) as records, count(*) filter (o_orderkey % 31 = 0 or o_orderstatus = 'F' or o_orderstatus not in ('F', 'O')) as refused, count(*) filter (o_orderkey % 31 = 0 or o_orderstatus <> 'O') = 0 as admitted from orders group by 1""")
def eligibility_gate(t: Tables):
    s = F.when(F.col("o_orderstatus") == "F", "candidate").when(F.col("o_orderstatus") == "O", "reviewed").otherwise("odd")
    r = t.orders.select(F.col("o_custkey").alias("batch"), s.alias("status"), F.when(F.col("o_orderkey") % 31 == 0, "remove").otherwise("upsert").alias("action"))
    return ed.admitted_batches(ed.eligibility(r, F.lit("live")), "batch")


_GRAPH = """n as (select 'b' || p_brand as id, 'brand' as type from part union all select 's' || p_size, 'size' from part), e as (select 'b' || p_brand || '-s' || p_size as id, 'HAS_SIZE' as type from part)"""


def _part_graph(t: Tables):
    b, s = F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("s"), F.col("p_size").cast("string"))
    nodes = t.part.select(b.alias("id"), F.lit("brand").alias("type")).unionByName(t.part.select(s.alias("id"), F.lit("size").alias("type")))
    return nodes, t.part.select(F.concat_ws("-", b, s).alias("id"), F.lit("HAS_SIZE").alias("type"), b.alias("source"), s.alias("target"))


@query(f"""with {_GRAPH} select 'nodes' as measure, '' as kind, count(distinct id) as n from n union all select 'edges', '', count(distinct id) from e union all select 'merged nodes', '', count(*) - count(distinct id) from n
union all select 'merged edges', '', count(*) - count(distinct id) from e union all select 'nodes of type', type, count(distinct id) from n group by type union all select 'edges of type', type, count(distinct id) from e group by type""")
def graph_summary(t: Tables):
    return ed.graph_summary(*_part_graph(t))


@query("""with r as (select l_orderkey as f, l_linenumber as o, floor(l_quantity)::bigint as b, l_suppkey % 4 as ev, l_returnflag as c, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) as i from lineitem),
f as (select f, count(*) as c, sum(ev) as raw from r group by 1), x as (select * from r where i = 1)
select 'manifest_records' as measure, count(*)::bigint as n from r union all select 'files_verified', count(*) from f union all select 'rendered_bytes_verified', sum(b)::bigint from x union all select 'duplicate_groups', count(*) from f where c > 1
union all select 'raw_history_events', sum(raw)::bigint from f union all select 'history_events', sum(ev)::bigint from x union all select 'class ' || c, count(*) from x group by c""")
def harvest_proof(t: Tables):
    r = t.lineitem.select(F.col("l_orderkey").alias("filename"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("order"), F.floor("l_quantity").alias("rendered_bytes"), (F.col("l_suppkey") % 4).alias("events"), F.col("l_returnflag").alias("classification"))
    return ed.harvest_proof(r)


@query("select * from (values ('authority_trail', true), ('cited_by', true), ('related_case', false), ('filter_bound', true)) v(name, passed)")
def readiness_cases(t: Tables):
    o = t.orders
    node = lambda kind, c: o.select(F.concat(F.lit(kind), c.cast("string")).alias("id"), F.lit(kind).alias("type"))
    nodes = node("opinion", F.col("o_orderkey")).unionByName(node("court", F.col("o_orderstatus")))
    edge = lambda kind, a, b: o.select(F.lit(kind).alias("type"), a.alias("source"), b.alias("target"))
    opinion = F.concat(F.lit("opinion"), F.col("o_orderkey").cast("string"))
    edges = edge("cites_case", opinion, F.lit("opinion1")).unionByName(edge("same_docket", opinion, F.lit("nowhere"))).unionByName(edge("same_court", opinion, F.concat(F.lit("court"), "o_orderstatus")))
    return ed.readiness(nodes, edges)


@query("select event_type, sum(floor(value)::bigint)::bigint as tokens, count(*) as calls, floor(epoch(max(ts)))::bigint as last_epoch from events group by 1")
def embedding_usage(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.floor("value")).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.unix_timestamp(F.max("ts")).alias("last_epoch"))


@query("""with k as (select event_type, unnest(json_keys(props)) as k from events) select event_type, string_agg(distinct k, ',' order by k) as keys from k group by 1""")
def record_keys(t: Tables):
    keys = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.json_object_keys("props")))))
    return t.events.groupBy("event_type").agg(F.array_join(keys, ",").alias("keys"))


@query("select event_id, case when (props->>'$.k') is not null then 'k=' || (props->>'$.k') else '' end as kept from events")
def restricted_attributes(t: Tables):
    held = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, _: k.isin("k", "region"))
    return t.events.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(held)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


# ---- hydration, expansion, versions ---------------------------------------------------------------------------------------


@query("""with h as (select o_custkey as query_id, o_orderkey as chunk_id, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders),
l as (select l_orderkey, arg_max(l_suppkey, (l_shipdate, l_linenumber)) as link from lineitem group by 1)
select query_id, chunk_id, rank::int as rank, c_name as title, link from h join orders on o_orderkey = chunk_id join customer on c_custkey = o_custkey left join l on l_orderkey = o_custkey where rank <= 5 and o_orderkey % 6 <= 2 and (o_orderkey % 4 <> 1)""")
def hydrate_hits(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    hits = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.row_number().over(w).alias("rank")).where("rank <= 5")
    groups = F.when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("closed"))).otherwise(F.array().cast("array<string>"))
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"), (F.col("o_orderkey") % 6).cast("int").alias("level"), groups.alias("groups"), F.array().cast("array<string>").alias("roles"))
    docs = t.customer.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("title"))
    first = F.min_by("l_suppkey", F.struct("_metadata.file_path", "_metadata.row_index"))  # of links made at once the one stored first
    links = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id"), F.struct("l_shipdate", "l_linenumber").alias("created_at")).agg(first.alias("link")).withColumn("link_id", F.lit(0))
    return rt.hydrate(hits, chunks, docs, links, Principal("t", "i", ("open",), (), 2)).select("query_id", "chunk_id", "rank", "title", "link")


@query("""with f as (select l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) as part from lineitem group by 1), r as (select o_orderkey as d, row_number() over (partition by o_custkey order by o_orderkey) as rank, o_custkey as q from orders)
select q as query_id, d as document_id, part, round(0.66 - 0.01 * rank, 4)::double as score from r join f on l_orderkey = d""")
def graph_hydrate(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    related = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("document_id"), F.row_number().over(w).alias("rank"))
    chunks = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_partkey").alias("part"))
    return gr.first_chunk(related, chunks).select("query_id", "document_id", "part", "score")


@query("""with h as (select o_custkey as q, o_orderkey as c, row_number() over (partition by o_custkey order by o_orderkey) as rank from orders), a as (select c_custkey as q, c_nationkey as c, 1 as rank from customer),
u as (select q, c, rank, case when rank = 1 then 0 else 2 end as p from h union all select q, c, rank, 1 from a) select q as query_id, c as chunk_id, row_number() over (partition by q order by p, rank)::int as position from u""")
def interleave_hits(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    hits = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.row_number().over(w).alias("rank"))
    added = t.customer.select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("long").alias("chunk_id"), F.lit(1).alias("rank"))
    return gr.interleave(hits, added).select("query_id", "chunk_id", "position")


@query("""with x as (select o_orderkey as source, 'See Section ' || (o_custkey % 40) || ' and Section ' || (o_orderkey % 40) as t from orders), r as (select distinct source, unnest(regexp_extract_all(t, 'Section (\\d+)', 1)) as key from x)
select source, key, n_nationkey as target, n_nationkey is not null as resolved from r left join nation on n_nationkey::varchar = key""")
def section_references(t: Tables):
    text = F.concat(F.lit("See Section "), (F.col("o_custkey") % 40).cast("string"), F.lit(" and Section "), (F.col("o_orderkey") % 40).cast("string"))
    nodes = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("label"))
    return gr.resolve_references(t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text")), nodes, r"Section (\d+)").select("source", "key", "target", "resolved")


@query("select case n_nationkey % 3 when 0 then 'REPEALS' when 1 then 'ADOPTS' else 'AMENDS' end as type, n_nationkey as source, c_custkey as target from nation join customer on c_nationkey = n_nationkey")
def ordinance_graph(t: Tables):
    text = F.when(F.col("n_nationkey") % 3 == 0, "It is repealed.").when(F.col("n_nationkey") % 3 == 1, "Adopting the code").otherwise("Changes")
    ordinances = t.nation.select(F.col("n_nationkey").alias("number"), F.col("n_nationkey").alias("id"), text.alias("text"))
    return gr.ordinance_edges(ordinances, t.customer.select(F.col("c_nationkey").alias("number"), F.col("c_custkey").alias("section_id"))).select("type", "source", "target")


@query("""select o_orderkey, coalesce(case when o_orderkey % 3 = 0 then c_custkey end, case when o_orderkey % 3 = 1 then c_custkey + 1000000 end, s.s_suppkey + 2000000) as target_id
from orders left join customer on c_custkey = o_custkey left join supplier s on s.s_suppkey = o_custkey % 50""")
def version_targets(t: Tables):
    k = F.col("o_orderkey") % 3
    incoming = t.orders.select("o_orderkey", F.when(k == 0, F.concat(F.lit("id"), "o_custkey")).alias("source_identity"), F.when(k == 1, F.concat(F.lit("uri"), "o_custkey")).alias("source_uri"), F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("filename"))
    none = F.lit(None).cast("string")
    known = t.customer.select(F.col("c_custkey").alias("document_id"), F.concat(F.lit("id"), "c_custkey").alias("source_identity"), none.alias("source_uri"), none.alias("filename"))
    known = known.unionByName(t.customer.select((F.col("c_custkey") + 1000000).alias("document_id"), none.alias("source_identity"), F.concat(F.lit("uri"), "c_custkey").alias("source_uri"), none.alias("filename")))
    known = known.unionByName(t.supplier.select((F.col("s_suppkey") + 2000000).alias("document_id"), none.alias("source_identity"), none.alias("source_uri"), F.concat(F.lit("f"), "s_suppkey").alias("filename")))
    return lc.version_target(incoming, known).select("o_orderkey", "target_id")


@query("select p_partkey from part where not (p_size > 40) and p_partkey not in (select ps.l_partkey from lineitem ps where ps.l_quantity > 48)")
def deletions(t: Tables):
    left = lc.delete_where(t.part, F.col("p_size") > 40)
    return lc.delete_ids(left, t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@query("""with r as (select o_custkey, list(o_orderkey order by o_totalprice desc, o_orderkey) as r, min(o_orderkey) as w from orders group by 1) select o_custkey, r[1] = w as at_1, list_contains(r[1:3], w) as at_3, len(list_filter(r[1:3], lambda x: not list_contains(r, x))) = 0 as cited from r""")
def sampled_recall(t: Tables):
    ranked = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"])
    r = t.orders.groupBy("o_custkey").agg(ranked.alias("r"), F.min("o_orderkey").alias("w"))
    at = lambda k: ev.recall_at(F.col("r"), F.col("w"), k)
    return r.select("o_custkey", at(1).alias("at_1"), at(3).alias("at_3"), ev.cited_in_retrieved(F.slice("r", 1, 3), F.col("r")).alias("cited"))


@query("select doc_id, array_to_string(list_filter([case when length(text) < 200 then 'below minimum: chars' end, case when not contains(text, 'the') then 'missing: the' end], lambda x: x is not null), ';') as reasons from documents")
def extraction_profile(t: Tables):
    return t.documents.select("doc_id", F.array_join(ev.profile_checks(F.col("text"), {"chars": F.length("text") >= 200}, ["the"]), ";").alias("reasons"))


@query(r"""with c as (select o_orderkey, lpad((o_orderkey % 1000)::varchar, 3, '0') || '-' || lpad((o_custkey % 100)::varchar, 2, '0') || '-' || lpad((o_orderkey % 10000)::varchar, 4, '0') || '-' || case when o_orderkey % 5 = 0 then 'x' else lpad((o_custkey % 10000)::varchar, 4, '0') end as c from orders)
select o_orderkey, case when o_orderkey % 5 <> 0 then c[1:3] end as agency, case when o_orderkey % 5 <> 0 then regexp_replace(c[5:6], '^0+(.)', '\1') end as fund, case when o_orderkey % 5 <> 0 then c[8:11] end as account, case when o_orderkey % 5 <> 0 then c[13:16] end as program from c""")
def account_codes(t: Tables):
    pad = lambda c, n: F.lpad((c % 10**n).cast("string"), n, "0")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    code = F.concat_ws("-", pad(k, 3), pad(u, 2), pad(k, 4), F.when(k % 5 == 0, "x").otherwise(pad(u, 4)))
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in tx.structured_code(code).items()])


@query("""with r as (select l_orderkey as q, l_partkey % 7 as f, max(l_quantity) as s, min(l_shipmode) as n from (select *, l_linestatus as l_shipmode from lineitem) group by 1, 2), k as (select *, row_number() over (partition by q order by s desc, f) as rank from r)
select q as query_id, f as file_id, rank::int as rank, s as score, n as filename from k where rank <= 3""")
def file_search(t: Tables):
    part = (F.col("l_partkey") % 7)
    r = t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.lit("one").alias("text"), part.alias("file_id"), F.col("l_linestatus").alias("filename"), F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("store_id"), part.alias("chunk_id"))
    return rt.file_search_results(r, 3).select("query_id", "file_id", "rank", "score", "filename")


# ---- the stored search ----------------------------------------------------------------------------------------------------


@query()
def ingest_and_search(t: Tables):
    """Documents ingested to a store in the shared folder and searched by one caller, who may read levels up to 2."""
    none = F.array().cast("array<string>")
    docs = t.documents.select(
        F.col("doc_id").alias("document_id"), "text", F.lit(1).alias("version"), F.lit("t").alias("tenant_id"), F.lit("i").alias("instance_id"), F.lit(True).alias("active"),
        (F.col("doc_id") % 4).cast("int").alias("level"), none.alias("groups"), none.alias("roles"),
    )
    ig.ingest(docs, path := new_folder(t.spark))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    return ig.stored_search(t.spark, path, queries, 5, Principal("t", "i", max_level=2)).select("query_id", "rank", "chunk_id", "document_id", F.round("score", 6).alias("score"), "level")


@query("""with k as (select o_orderkey as k, o_custkey as c from orders)
select 'CONTAINS' as type, 'Chapter ' || c as source, '2.10.' || k as target from k
union all select 'REFERENCES', '2.10.' || k, '2.10.' || (k + 1) from k
union all select 'DEFINES', '2.10.' || k, 'Term ' || k from k union all select 'HAS_ORDINANCE_HISTORY', '2.10.' || k, 'Ordinance ' || (10000 + c) from k""")
def code_page_graph(t: Tables):
    """A chapter for each customer, with a section for each order: each defines a term, names an ordinance and refers to the next section."""
    k, root = F.col("o_orderkey").cast("string"), "https://code.example/TMC"
    # A page is far larger than its order: orders are dealt first, to as many tasks as a shuffle has, not as their own size needs.
    dealt = lambda c: t.orders.select("o_orderkey", "o_custkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), c)
    body = F.concat(
        F.lit("<html><body><nav><a href='/x'>x</a></nav><main><h1>2.10."), k, F.lit(" About it</h1><p>“Term "), k, F.lit("” means a thing &amp; more.</p><p>It goes on.</p><p>(Ord. "),
        (F.col("o_custkey") + 10000).cast("string"), F.lit(" § 3, 1-2-2020.)</p><p>See <a href='/TMC/2.10."), (F.col("o_orderkey") + 1).cast("string"), F.lit("#a'>next</a>.</p><p>Privacy Policy</p></main></body></html>"),
    )
    pages = dealt("o_orderkey").select(F.concat(F.lit(f"{root}/2.10."), k).alias("url"), body.alias("html"))
    links = F.array_join(F.transform(F.collect_list("o_orderkey"), lambda x: F.concat(F.lit("<li><a href='/TMC/2.10."), x.cast("string"), F.lit("'>s</a></li>"))), "")
    who = F.col("o_custkey").cast("string")
    chapter = dealt("o_custkey").groupBy("o_custkey").agg(links.alias("links"))
    chapter = chapter.select(F.concat(F.lit(f"{root}/ch"), who).alias("url"), F.concat(F.lit("<main><h2>Chapter "), who, F.lit(" All</h2><ul>"), "links", F.lit("</ul></main>")).alias("html"))
    nodes, edges = cp.code_graph(cut(cp.page_model(pages.unionByName(chapter), root)))
    name = F.when(F.col("type") == "chapter", F.concat(F.lit("Chapter "), F.regexp_replace("label", " All$", ""))).otherwise(F.regexp_replace("label", " About it$", ""))
    named = nodes.select("id", name.alias("name"))
    a, b = (named.select(F.col("id").alias(e), F.col("name").alias(f"_{e}")) for e in ("source", "target"))
    return edges.join(a, "source").join(b, "target").select("type", F.col("_source").alias("source"), F.col("_target").alias("target"))
