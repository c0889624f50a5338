"""Queries over stored indexes: dense lists with codes, blocks of postings, positions, and a store that is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.lineage import new_folder
from brindle.operators import dense_index as di
from brindle.operators import graph as gr
from brindle.operators import ingest as ig
from brindle.operators import lexical_index as lx
from brindle.operators import lifecycle as lc
from brindle.operators import retrieval as rt
from brindle.plans.registry import Tables, query
from brindle.plans.retrieval_plans import _BM25, _DENSE, _vectors
from brindle.plans.text_plans import _tokens

LISTS = 16


def _dense_index(t: Tables) -> tuple[str, DataFrame]:
    q, e = _vectors(t)
    at = new_folder(t.spark)
    di.build(e, at, keep=["label"], lists=LISTS)
    return at, q


@query(f"with {_DENSE} select query_id, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s) where rank <= 10")
def dense_index_all_lists(t: Tables):
    """Every list probed and ranked by its vectors: the exact answer through the index."""
    at, q = _dense_index(t)
    return di.search(t.spark, at, q, 10, LISTS, places=6)


@query()
def dense_index_topk(t: Tables):
    """As many lists as a sample needs, by codes, and as many rows again by their vectors."""
    at, q = _dense_index(t)
    return di.search(t.spark, at, q, 10, *di.tuned(t.spark, at, 10), places=6)


@query(f"""with {_DENSE} select query_id, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s where label % 2 = 0) where rank <= 5""")
def dense_index_scoped(t: Tables):
    """Only rows of some labels may be found: the scope is applied in the index, before any cut."""
    at, q = _dense_index(t)
    labels = t.embeddings.where("label % 2 = 0").select("label").distinct()
    return di.search(t.spark, at, q, 5, LISTS, allowed=labels, places=6)


def _blocks(t: Tables) -> DataFrame:
    lx.write_where_made(lx.chunk_blocks(t.documents, chunk_id="doc_id"), at := new_folder(t.spark))
    return lx.read(t.spark, at)


def _queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


@query(f"with {_BM25} select query_id, chunk_id, score from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from b) where r <= 10")
def bm25_blocks(t: Tables):
    index = _blocks(t)
    n = t.documents.count()
    terms = index.agg(F.sum(F.aggregate(F.arrays_zip("tfs"), F.lit(0).cast("long"), lambda a, x: a + x["tfs"]))).first()[0] or 0
    return lx.search(_queries(t), index, float(n), terms / max(n, 1), 10, places=6).select("query_id", "chunk_id", "score")


# a phrase of the first two words, the fifth, without the third; or the sixth word
_WEB = f"""q as (select item_id as query_id, {_tokens('text')} as k from benchmark),
cl as (select query_id, 0 as alt, 1 as clause, false as neg, [k[1], k[2]] as words from q union all select query_id, 0, 2, false, [k[5]] from q
  union all select query_id, 0, 3, true, [k[3]] from q union all select query_id, 1, 1, false, [k[6]] from q),
d as (select doc_id as chunk_id, {_tokens('text')} as t from documents), pos as (select chunk_id, unnest(t) as term, unnest(range(len(t))) as p from d),
w as (select query_id, alt, clause, neg, len(words) as n, unnest(words) as term, unnest(range(len(words))) as o from cl),
occ as (select query_id, alt, clause, neg, chunk_id, p - o as s from w join pos using (term) group by query_id, alt, clause, neg, n, chunk_id, p - o having count(*) = n),
fit as (select query_id, alt, chunk_id from occ group by all having not bool_or(neg) and count(distinct clause) = case when alt = 0 then 2 else 1 end),
o as (select occ.* from occ semi join fit on occ.query_id = fit.query_id and occ.alt = fit.alt and occ.chunk_id = fit.chunk_id),
la as (select e.query_id, e.alt, e.chunk_id, e.s as e, l.clause, max(l.s) as b from (select distinct query_id, alt, chunk_id, s from o) e join o l on e.query_id = l.query_id and e.alt = l.alt and e.chunk_id = l.chunk_id and l.s <= e.s group by all),
whole as (select query_id, alt, chunk_id, e, min(b) as b from la group by query_id, alt, chunk_id, e having count(*) = case when alt = 0 then 2 else 1 end),
cover as (select query_id, alt, chunk_id, b, min(e) as e from whole group by all),
dense as (select query_id, alt, chunk_id, sum(0.1::double / (1 + greatest(0, e - b - case when alt = 0 then 1 else 0 end))) as s from cover group by all),
best as (select query_id, chunk_id, round(max(s), 6) as score from dense group by all)"""


@query(f"with {_WEB} select query_id, chunk_id, score, r::int as rank from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as r from best) where r <= 20")
def web_search(t: Tables):
    """Web searches made of each benchmark text's words: a phrase, a word and an exclusion, or another word; by cover density."""
    k = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    k = F.filter(k, lambda x: ~x.isin(*_stopwords()))
    at = lambda i: F.try_element_at(k, F.lit(i))
    asked = F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" '), at(5), F.lit(" -"), at(3), F.lit(" or "), at(6))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), asked.alias("text"))
    return lx.web_search(queries, _blocks(t), 20, places=6)


def _stopwords() -> tuple[str, ...]:
    from brindle.functions.text import STOPWORDS

    return tuple(STOPWORDS)


@query("""with v as (select 't' || (doc_id % 2) as tenant_id, doc_id as document_id, text || case when doc_id % 10 = 0 then ' changed' else '' end as text from documents where doc_id % 10 <> 1)
select tenant_id, min(document_id) as document_id, sha256(text) as content_hash from v group by tenant_id, text""")
def incremental_store(t: Tables):
    """Two ingests of two tenants' documents: in the second a tenth of them has changed and a tenth is gone. What is live then."""
    none = F.array().cast("array<string>")
    docs = t.documents.select(
        F.col("doc_id").alias("document_id"), "text", F.lit(1).alias("version"), F.concat(F.lit("t"), (F.col("doc_id") % 2).cast("string")).alias("tenant_id"), F.lit("i").alias("instance_id"),
        F.lit(True).alias("active"), F.lit(1).alias("level"), none.alias("groups"), none.alias("roles"),
    )
    at = new_folder(t.spark)
    ig.ingest(docs, at)
    changed = F.when(F.col("document_id") % 10 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    ig.ingest(docs.where("document_id % 10 <> 1").withColumn("text", changed).withColumn("version", F.lit(2)), at, complete=True)
    return ig.open_store(t.spark, at).live("documents").select("tenant_id", "document_id", "content_hash")


@query("""with recent as (select o_custkey, max(o_orderkey) as v from orders group by 1)
select l_orderkey as chunk_id, o_custkey as document_id, v as current_version_id, o.o_orderdate as version_date from (select distinct l_orderkey from lineitem where l_orderkey % 50 = 0) h
join (select o_orderkey, o_custkey from orders) c on l_orderkey = c.o_orderkey join recent using (o_custkey) left join (select o_orderkey, o_orderdate from orders where o_orderstatus <> 'P') o on v = o.o_orderkey""")
def hydrate_versions(t: Tables):
    """Hits with their document's current version, where it is known: customers are documents, their orders versions and chunks."""
    hits = t.lineitem.where("l_orderkey % 50 = 0").select(F.col("l_orderkey").alias("chunk_id")).distinct()
    chunks = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("document_id"))
    documents = t.orders.groupBy(F.col("o_custkey").alias("document_id")).agg(F.max("o_orderkey").alias("current_version_id"))
    versions = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("current_version_id"), F.col("o_orderdate").alias("version_date"))
    return rt.hydrate(hits, chunks, documents, versions=versions).select("chunk_id", "document_id", "current_version_id", "version_date")


@query("""with parsed as (select 'c' || o_custkey as id, 'section' as type, 'parsed ' || o_custkey as label, max(o_orderkey) as parsed from orders group by 1, 3),
listed as (select 'c' || c_custkey as id, 'entry' as type, c_name as label, c_nationkey as listed from customer)
select id, case when p.id is not null then 'section' else 'entry' end as type, coalesce(l.label, p.label) as label, l.listed::varchar as listed, p.parsed::varchar as parsed, ((l.id is not null)::int + (p.id is not null)::int)::int as merged
from listed l full join parsed p using (id)""")
def manifest_and_parsed_nodes(t: Tables):
    """A manifest's nodes and those that parsing finds, by id (U6): the manifest's label, `section` as the type, the properties of both."""
    number = lambda c: F.col(c).cast("string")
    name = lambda c: F.concat(F.lit("c"), number(c)).alias("id")
    listed = t.customer.select(name("c_custkey"), F.lit("entry").alias("type"), F.col("c_name").alias("label"), F.create_map(F.lit("listed"), number("c_nationkey")).alias("properties"), F.lit(0).alias("source"))
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    parsed = last.select(name("o_custkey"), F.lit("section").alias("type"), F.concat(F.lit("parsed "), number("o_custkey")).alias("label"), F.create_map(F.lit("parsed"), number("k")).alias("properties"), F.lit(1).alias("source"))
    merged = gr.merge_nodes(listed.unionByName(parsed), "source")
    of = lambda k: F.try_element_at("properties", F.lit(k)).alias(k)
    return merged.select("id", "type", "label", of("listed"), of("parsed"), "merged")


@query("""select o_orderkey, array_to_string(list_filter([case when gone or o_totalprice > 200000 then 'customer' end, case when gone or o_orderstatus = 'P' then 'status' end], lambda x: x is not null), ',') as unbound
from (select *, o_orderpriority like '5%' as gone from orders) where gone or o_totalprice > 200000 or o_orderstatus = 'P'""")
def unbound_artifacts(t: Tables):
    """Orders as artifacts that declare a customer and a status; in their revisions dear ones have another customer, partial ones another
    status, and those of the last priority are missing."""
    artifacts = t.orders.select("o_orderkey", F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"))
    there = t.orders.where(~F.col("o_orderpriority").startswith("5"))
    customer = F.when(F.col("o_totalprice") > 200_000, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))
    revisions = there.select("o_orderkey", customer.alias("customer"), F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus")).alias("status"))
    return lc.unbound_fields(artifacts, revisions, "o_orderkey", ["customer", "status"]).select("o_orderkey", F.array_join("unbound", ",").alias("unbound"))


@query("""with recursive h as (select o_orderkey as id, o_custkey as c, row_number() over (partition by o_custkey order by o_orderkey) as n, count(*) over (partition by o_custkey) as m, o_orderpriority as content from orders),
w as (select id, c, n, sha256(sha256(content)) as hash from h where n = m
  union all select h.id, h.c, h.n, sha256(sha256(h.content) || w.hash) from w join h on h.c = w.c and h.n = w.n - 1)
select id, hash from w""")
def chain_hashes(t: Tables):
    """Each customer's orders as a chain, every order the child of the one before: trees as deep as a customer has orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t.orders.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(w).alias("parent"), F.lit(0).alias("ordinal"), F.col("o_orderpriority").alias("content"), (F.row_number().over(w) - 1).alias("level"))
    return gr.subtree_hashes(o)
