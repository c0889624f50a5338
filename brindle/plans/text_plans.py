"""Queries over text functions, identities and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import hashing as hs
from brindle.functions import python as py
from brindle.functions import text as tx
from brindle.operators import chunking as ck
from brindle.operators import usage
from brindle.plans.registry import Tables, query
from brindle.sources import readers

_RE2 = {k: p.replace("(?is)", "").replace("(?i)", "") for k, p, _ in tx.REDACTIONS}
_FLAGS = {k: ("is" if "(?is)" in p else "i" if "(?i)" in p else "") for k, p, _ in tx.REDACTIONS}
_PUT = {k: v.replace("$1", r"\1") for k, _, v in tx.REDACTIONS}
_NO_LOOK = [k for k, _, _ in tx.REDACTIONS if k != "phone"]  # the SQL's engine has no look-around


def _q(s: str) -> str:
    return s.replace("'", "''")


def _redacted(c: str, upto: int | None = None) -> str:
    for k in _NO_LOOK[:upto]:
        c = f"regexp_replace({c}, '{_q(_RE2[k])}', '{_q(_PUT[k])}', 'g{_FLAGS[k]}')"
    return c


def _counts(c: str) -> str:
    return ", ".join(
        f"len(regexp_extract_all({_redacted(c, i)}, '{_q(_RE2[k])}', 0, '{_FLAGS[k]}'))::int as {k}" for i, k in enumerate(_NO_LOOK)
    )


@query(r"""select doc_id, greatest(1, len(regexp_extract_all(text, '\S+')) * 4 // 3)::int as tokens,
    greatest(1, ceil(length(text) / 2.0))::int as embedding_tokens, ((length(text) + 3) // 4)::int as response_tokens from documents""")
def token_estimates(t: Tables):
    c = F.col("text")
    return t.documents.select("doc_id", tx.estimate_tokens(c).alias("tokens"), tx.estimate_embedding_tokens(c).alias("embedding_tokens"), tx.estimate_response_tokens(c).alias("response_tokens"))


_WINDOWS = r"""
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as w from documents),
c as (select doc_id, 0 as ordinal, text from w where len(w) <= 600 union all
    select doc_id, (i // 510)::int, array_to_string(w[i + 1 : i + 600], ' ') from
        (select doc_id, w, unnest(range(0, len(w), 510)) as i from w where len(w) > 600) where i = 0 or i + 90 < len(w))"""


@query(f"with {_WINDOWS} select doc_id, ordinal, text, greatest(1, len(regexp_extract_all(text, '\\S+')) * 4 // 3)::int as token_count from c")
def chunk_word_windows(t: Tables):
    return ck.chunk_words(t.documents.select("doc_id", "text"))


@query(f"select doc_id, {_redacted('text')} as text from documents")
def redact_pii(t: Tables):
    return t.documents.select("doc_id", tx.redact(F.col("text"), leave=("phone",)).alias("text"))


@query()
def redact_pii_all_rules(t: Tables):
    return t.documents.select("doc_id", tx.redact(F.col("text")).alias("text"))


@query("select type, sum(n)::bigint as n from (unpivot (select " + _counts("text") + " from documents) on columns(*) into name type value n) group by type having sum(n) > 0")
def redaction_totals(t: Tables):
    rows = t.documents.select(F.explode(tx.redaction_counts(F.col("text"), leave=("phone",))).alias("r"))
    return rows.groupBy("r.type").agg(F.sum("r.count").cast("long").alias("n"))


def _normal(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^[ \t\r\n?.!]+|[ \t\r\n?.!]+$', '', 'g')"


def _rewritten(base: str) -> str:
    out = base
    for _ in range(4):
        out = rf"trim(regexp_replace({out}, '{tx.FILLER[4:]}', '', 'i'))"
    out = _normal(rf"trim(regexp_replace({out}, '\bwhat\s+(?:was|were|is|are)\s+the\s+', '', 'gi'))")
    return f"case when {out} = '' then {base} else {out} end"


@query(f"with q as (select item_id, {_normal(chr(39) + 'Please find  ' + chr(39) + ' || case when item_id % 2 = 0 then ' + chr(39) + 'show me what is the ' + chr(39) + ' else ' + chr(39) * 2 + ' end || text')} as q from benchmark) select item_id, q as normal, {_rewritten('q')} as rewritten from q")
def query_rewrite(t: Tables):
    q = F.concat(F.lit("Please find  "), F.when(F.col("item_id") % 2 == 0, "show me what is the ").otherwise(""), F.col("text"))
    return t.benchmark.select("item_id", tx.normalize_query(q).alias("normal"), tx.rewrite_query(q).alias("rewritten"))


@query(rf"""with p as (select item_id, {_normal('text')} as base from benchmark),
x as (select item_id, base, unnest(regexp_split_to_array(regexp_replace(base, '\s+(?:and|also)\s+|[;?]+', chr(1), 'gi'), chr(1))) as raw, generate_subscripts(regexp_split_to_array(regexp_replace(base, '\s+(?:and|also)\s+|[;?]+', chr(1), 'gi'), chr(1)), 1) as i from p),
n as (select item_id, i, {_normal('raw')} as part from x),
k as (select item_id, part, i, row_number() over (partition by item_id, lower(part) order by i) as r from n where len(regexp_extract_all(part, '\S+')) >= 2),
a as (select item_id, list(part order by i)[1:4] as parts from k where r = 1 group by item_id)
select p.item_id, array_to_string(coalesce(a.parts, [base]), chr(10)) as subqueries, len(coalesce(a.parts, [base]))::int as n from p left join a using (item_id)""")
def query_decompose(t: Tables):
    parts = t.benchmark.select("item_id", tx.decompose_query(F.col("text")).alias("p"))
    return parts.select("item_id", F.array_join("p", "\n").alias("subqueries"), F.size("p").alias("n"))


_LEGAL = "case when o_orderkey % 2 = 0 then 'Unpublished Court of Appeals docket no. ' else 'published  Kansas Supreme Court No. ' end || (10000 + o_orderkey) || ' decided ' || case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y') end"


def _legal(t: Tables):
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy"))
    head = F.when(F.col("o_orderkey") % 2 == 0, "Unpublished Court of Appeals docket no. ").otherwise("published  Kansas Supreme Court No. ")
    return t.orders.select("o_orderkey", F.concat(head, (F.col("o_orderkey") + 10000).cast("string"), F.lit(" decided "), day).alias("q"))


def _ci(p: str) -> str:
    return _q(p.replace("(?i)", ""))


@query(f"""with q as (select o_orderkey, {_normal(_LEGAL)} as q from orders),
d as (select *, nullif(regexp_extract(q, '{_ci(tx.DECISION_DATE)}', 1), '') as decision_date from q)
select o_orderkey, coalesce(nullif(regexp_extract(q, '{_ci(tx.DOCKET_LABELLED)}', 1, 'i'), ''), nullif(regexp_extract(q, '{_ci(tx.DOCKET)}', 1, 'i'), '')) as docket_number, decision_date,
    coalesce(substr(decision_date, 1, 4), nullif(regexp_extract(q, '{_ci(tx.DECISION_YEAR)}', 1), '')) as decision_year,
    case when regexp_matches(q, '{_ci(tx.APPEALS)}', 'i') then 'Court of Appeals' when regexp_matches(q, '{_ci(tx.SUPREME)}', 'i') then 'Supreme Court' end as court,
    case when regexp_matches(q, '{_ci(tx.UNPUBLISHED)}', 'i') then 'Unpublished' when regexp_matches(q, '{_ci(tx.PUBLISHED)}', 'i') then 'Published' end as status from d""")
def legal_planner(t: Tables):
    return _legal(t).select("o_orderkey", *[c.alias(n) for n, c in tx.legal_attributes(F.col("q")).items()])


def _effective(c: str) -> str:
    out = c
    for p in (tx.DOCKET_LABELLED, tx.DOCKET, tx.DECISION_DATE, tx.DECISION_YEAR, tx.UNPUBLISHED, tx.PUBLISHED, tx.APPEALS, tx.SUPREME, r"\b(?:from|in|on|decided)\s*$"):
        out = f"regexp_replace({out}, '{_ci(p)}', ' ', 'gi')"
    return out


@query(f"""with q as (select o_orderkey, {_normal(_LEGAL)} as base from orders), e as (select *, {_normal(_effective('base'))} as left_over from q),
r as (select *, {_rewritten('left_over')} as short from e) select o_orderkey, case when short = '' then base else short end as effective from r""")
def legal_effective_query(t: Tables):
    return _legal(t).select("o_orderkey", tx.legal_effective_query(F.col("q")).alias("effective"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def _tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: not list_contains({_STOP}, x))"


@query(f"select doc_id, array_to_string(k, ' ') as tokens, len(k)::int as n, len(list_distinct(k))::int as different from (select doc_id, {_tokens('text')} as k from documents)")
def rerank_tokens(t: Tables):
    k = t.documents.select("doc_id", tx.rerank_tokens(F.col("text")).alias("k"))
    return k.select("doc_id", F.array_join("k", " ").alias("tokens"), F.size("k").alias("n"), F.size(F.array_distinct("k")).alias("different"))


SYMBOL_RUN = "[A-Za-z0-9][A-Za-z0-9_./:-]{2,}"


def _symbol(t: str) -> str:
    """Whether a run is a symbol: no stopword, and with a mark or digit, all in capitals, or with a capital after its first letter."""
    mixed = f"regexp_matches({t}, '[A-Z]') and regexp_matches({t}, '[a-z]') and not regexp_matches({t}, '^[A-Z][^A-Z]*$')"
    return f"not list_contains({_STOP}, lower({t})) and (regexp_matches({t}, '[_./:0-9-]') or (upper({t}) = {t} and regexp_matches({t}, '[A-Z]')) or ({mixed}))"


@query(f"""with q as (select page_id, regexp_extract_all(coalesce(url || ' ', '') || 'HTTPServer fooBar Plain the v1.2 x_y', '{SYMBOL_RUN}') as raw from pages),
p as (select page_id, unnest(raw) as t, unnest(range(len(raw))) as i from q), f as (select page_id, arg_min(t, i) as t, min(i) as i from p where {_symbol('t')} group by page_id, lower(t)),
k as (select *, row_number() over (partition by page_id order by i) as n from f)
select page_id, string_agg(t, ' ' order by i) as symbols, count(*)::int as n from k where n <= 32 group by page_id""")
def exact_symbols(t: Tables):
    s = t.pages.select("page_id", tx.exact_symbols(F.concat_ws(" ", "url", F.lit("HTTPServer fooBar Plain the v1.2 x_y"))).alias("s"))
    return s.select("page_id", F.array_join("s", " ").alias("symbols"), F.size("s").alias("n"))


@query(r"""with s as (select doc_id, trim(regexp_replace(regexp_replace(text || '【3†source】', '【\d+†source】', '', 'g'), '\s+', ' ', 'g')) as f from documents)
select doc_id, case when length(f) <= 120 then f else rtrim(substr(f, 1, 120)) || '...' end as snippet, '【' || doc_id || '†source】' as mark from s""")
def snippets(t: Tables):
    c = F.concat("text", F.lit("【3†source】"))
    return t.documents.select("doc_id", tx.snippet(c, 120).alias("snippet"), tx.citation_marker(F.col("doc_id")).alias("mark"))


@query(r"""with m as (select l_orderkey, l_linenumber, 'see ' || chr(57856) || 'cite' || chr(57858) || 'src_' || l_partkey || chr(57858) || 'L' || l_linenumber || case when l_quantity > 25 then '-L' || (l_linenumber + 3) else '' end || chr(57857) || '.' as text, l_partkey from lineitem)
select l_orderkey, l_linenumber, text, 'src_' || l_partkey as ids from m""")
def model_citations(t: Tables):
    n = F.col("l_linenumber")
    loc = tx.line_locator(n, F.when(F.col("l_quantity") > 25, n + 3))
    mark = tx.model_citation_marker(F.array(F.concat(F.lit("src_"), F.col("l_partkey").cast("string"))), loc)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("see "), mark, F.lit(".")).alias("text"))
    return rows.withColumn("ids", F.array_join(tx.model_citation_ids(F.col("text")), ","))


@query(r"""select p_partkey, trim(regexp_replace(lower(translate(p_name || ' – “$1,000”', '‐‑‒–—−‘’“”,$', '------''''""')), '\s+', ' ', 'g')) as folded,
    trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) as evidence, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as part,
    regexp_replace(p_brand, '\D+', '', 'g') as digits, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
    contains(' ' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) || ' ', ' steel ') as has_steel from part""")
def normal_forms(t: Tables):
    c = F.col
    return t.part.select(
        "p_partkey", tx.fold_text(F.concat("p_name", F.lit(" – “$1,000”"))).alias("folded"), tx.normalize_evidence(c("p_type")).alias("evidence"), tx.index_part(c("p_brand")).alias("part"),
        tx.digits(c("p_brand")).alias("digits"), tx.slug(c("p_type")).alias("slug"), tx.contains_phrase(c("p_type"), F.lit("STEEL")).alias("has_steel"),
    )


@query(r"""with u as (select page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) as host, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') as path from pages)
select page_id, case when host = 'blog.tionsh.example.net' and (path = '/en' or starts_with(path, '/en/')) then 'https://blog.tionsh.example.net' || path end as canonical from u""")
def canonical_urls(t: Tables):
    return t.pages.select("page_id", tx.canonical_url(F.col("url"), "https://blog.tionsh.example.net/en/").alias("canonical"))


_LOG = "strftime(ts, '%Y-%m-%d %H:%M:%S') || case event_type when 'error' then ' ERROR ' when 'click' then ' DEBUG ' when 'view' then ' ' else ' INFO ' end || event_type || case when value > 50 then ' WARN' else '' end"


def _log_line():
    level = F.when(F.col("event_type") == "error", " ERROR ").when(F.col("event_type") == "click", " DEBUG ").when(F.col("event_type") == "view", " ").otherwise(" INFO ")
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level, F.col("event_type"), F.when(F.col("value") > 50, " WARN").otherwise(""))


@query(f"select event_id, case " + " ".join(rf"when regexp_matches(line, '\b{s}\b') then '{s}'" for s in tx.SEVERITIES) + f" end as severity from (select event_id, {_LOG} as line from events)")
def log_severity(t: Tables):
    return t.events.select("event_id", tx.severity(_log_line()).alias("severity"))


def _user_logs(t: Tables):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("event_id", _log_line().alias("line")))), lambda x: x["line"])
    return t.events.groupBy("user_id").agg(F.array_join(lines, "\n").alias("text"))


@query(f"""with l as (select user_id, list({_LOG} order by event_id) as l from events group by user_id),
w as (select user_id, l, unnest(range(0, len(l), 70)) as i from l) select user_id, (i // 70)::int as ordinal, array_to_string(l[i + 1 : i + 80], chr(10)) as text from w where i = 0 or i + 10 < len(l)""")
def log_windows(t: Tables):
    return _user_logs(t).select("user_id", F.posexplode(ck.log_windows(F.col("text"))).alias("ordinal", "text"))


@query()
def chunk_log_events(t: Tables):
    return ck.chunk_documents(_user_logs(t), ["user_id"], mode="logs_errors_v1").select("user_id", "ordinal", "text", "first_line", "last_line", "severity")


_MD = r"""'# ' || p_brand || chr(10) || 'intro of ' || p_name || chr(10) || '## ' || split_part(p_type, ' ', 1) || chr(10) || 'size ' || p_size || chr(10) || '#### deep' || chr(10) || 'x' || chr(10) || '## ' || p_type || chr(10) || 'end'"""


def _markdown(t: Tables):
    text = F.concat(
        F.lit("# "), "p_brand", F.lit("\nintro of "), "p_name", F.lit("\n## "), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("\nsize "), F.col("p_size").cast("string"),
        F.lit("\n#### deep\nx\n## "), "p_type", F.lit("\nend"),
    )
    return t.part.select("p_partkey", text.alias("text"))


@query(r"""with s as (select p_partkey, unnest([
    {n: 1, path: p_brand, text: '# ' || p_brand || chr(10) || 'intro of ' || p_name, a: 1, b: 2}, {n: 2, path: p_brand || ' > ' || split_part(p_type, ' ', 1), text: '## ' || split_part(p_type, ' ', 1) || chr(10) || 'size ' || p_size, a: 3, b: 4},
    {n: 3, path: p_brand || ' > ' || split_part(p_type, ' ', 1) || ' > deep', text: '#### deep' || chr(10) || 'x', a: 5, b: 6}, {n: 4, path: p_brand || ' > ' || p_type, text: '## ' || p_type || chr(10) || 'end', a: 7, b: 8}]) as s from part)
select p_partkey, s.n::bigint as section, s.path as path, s.text as text, s.a::int as first_line, s.b::int as last_line from s""")
def chunk_headings(t: Tables):
    return ck.heading_sections(_markdown(t), "p_partkey").select("p_partkey", "section", F.array_join("heading_path", " > ").alias("path"), "text", "first_line", "last_line")


@query(r"""select p_partkey, (s.n - 1)::int as ordinal, s.path as path, s.text as text from (select p_partkey, unnest([
    {n: 1, path: p_brand, text: '# ' || p_brand || chr(10) || 'intro of ' || p_name}, {n: 2, path: p_brand || ' > ' || split_part(p_type, ' ', 1), text: '## ' || split_part(p_type, ' ', 1) || chr(10) || 'size ' || p_size},
    {n: 3, path: p_brand || ' > ' || split_part(p_type, ' ', 1) || ' > deep', text: '#### deep' || chr(10) || 'x'}, {n: 4, path: p_brand || ' > ' || p_type, text: '## ' || p_type || chr(10) || 'end'}]) as s from part)""")
def chunk_headings_udtf(t: Tables):
    return ck.chunk_documents(_markdown(t), ["p_partkey"]).select("p_partkey", "ordinal", F.array_join("heading_path", " > ").alias("path"), "text")


@query("""with n as (select *, row_number() over (partition by c_nationkey order by c_custkey) as n from customer),
g as (select c_nationkey, ((n - 1) // 25)::int as ordinal, min(n) as record_start, max(n) as record_end,
    string_agg('Record ' || n || ': c_custkey: ' || c_custkey || ' | c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment, chr(10) order by n) as body from n group by 1, 2)
select c_nationkey, ordinal, record_start::int as record_start, record_end::int as record_end, 'Schema fields: c_custkey, c_name, c_mktsegment' || chr(10) || 'Record range: ' || record_start || '-' || record_end || chr(10) || body as text from g""")
def chunk_record_groups(t: Tables):
    return ck.record_groups(t.customer, ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"], ["c_nationkey"])


@query("""with n as (select *, row_number() over (order by p_partkey) as n from part)
select ((n - 1) // 25)::int as ordinal, min(n)::bigint as record_start, max(n)::bigint as record_end,
    'Schema fields: p_partkey, p_brand' || chr(10) || 'Record range: ' || min(n) || '-' || max(n) || chr(10) || string_agg('Record ' || n || ': p_partkey: ' || p_partkey || ' | p_brand: ' || p_brand, chr(10) order by n) as text from n group by 1""")
def chunk_table_records(t: Tables):
    return ck.record_groups(t.part.select("p_partkey", "p_brand"), ["p_partkey", "p_brand"], ["p_partkey"])


_RECORDS = """'Schema fields: ' || {f} || chr(10) || 'Record range: ' || min(i) || '-' || max(i) || chr(10) || string_agg('Record ' || i || ': ' || {r}, chr(10) order by i)"""


@query(f"""with j as (select p_brand as id, p_partkey, p_size, row_number() over (partition by p_brand order by p_partkey) as i from part),
c as (select 'n' || s_nationkey as id, s_suppkey, s_name, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier),
m as (select 'r' || n_regionkey as id, n_nationkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)
select id, ((i - 1) // 25)::int as ordinal, {_RECORDS.format(f="'p_partkey, p_size'", r="'p_partkey: ' || p_partkey || ' | p_size: ' || p_size")} as text, 'records' as kind from j group by 1, 2
union all select id, ((i - 1) // 25)::int, {_RECORDS.format(f="'key, name'", r="'key: ' || s_suppkey || ' | name: ' || s_name")}, 'records' from c group by 1, 2
union all select id, ((i - 1) // 25)::int, 'Markdown table 1: Regions' || chr(10) || {_RECORDS.format(f="'key, name'", r="'key: ' || n_nationkey || ' | name: ' || n_name")}, 'markdown_table' from m group by 1, 2""")
def chunk_structured(t: Tables):
    """JSON, delimited and Markdown tables by the dispatcher."""
    rows = lambda key, cols, line: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, *cols))), line), "\n")
    j = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("p_partkey", "p_size")))).alias("text"))
    own = lambda x, mark: F.concat(x["k"].cast("string"), F.lit(mark), x["v"])
    c = t.supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("id"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    c = c.groupBy("id").agg(F.concat(F.lit("key,name\n"), rows("k", ["v"], lambda x: own(x, ","))).alias("text"))
    m = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("id"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    m = m.groupBy("id").agg(F.concat(F.lit("Regions\n\n| key | name |\n|---|---|\n"), rows("k", ["v"], lambda x: F.concat(F.lit("| "), own(x, " | "), F.lit(" |")))).alias("text"))
    return ck.chunk_documents(j.unionByName(c).unionByName(m), ["id"], mode="tables_csv_json_v1").select("id", "ordinal", "text", "kind")


@query("""with p as (select p_partkey, replace(p_brand, '#', '_') as c from part)
select p_partkey, 0 as ordinal, 'import os' as text, 'module_preamble' as symbol from p union all select p_partkey, 1, 'def f_' || p_partkey || '(x):' || chr(10) || '    return x', 'f_' || p_partkey from p
union all select p_partkey, 2, 'class ' || c || ':' || chr(10) || '    pass', c from p""")
def chunk_code(t: Tables):
    code = F.concat(F.lit("import os\n\ndef f_"), F.col("p_partkey").cast("string"), F.lit("(x):\n    return x\n\nclass "), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(":\n    pass\n"))
    return ck.chunk_documents(t.part.select("p_partkey", code.alias("text")), ["p_partkey"], mode="code_repo_v1").select("p_partkey", "ordinal", "text", F.array_join("heading_path", "/").alias("symbol"))


@query(r"""with l as (select l_orderkey, l_linenumber, case when l_linenumber % 3 = 1 then '<!-- page: ' || (l_linenumber + 10) || ' --> a' else 'b' end as text from lineitem)
select l_orderkey, l_linenumber, last_value(nullif(regexp_extract(text, 'page: (\d+)', 1), '')::int ignore nulls) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as page from l""")
def page_forward_fill(t: Tables):
    text = F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("<!-- page: "), (F.col("l_linenumber") + 10).cast("string"), F.lit(" --> a"))).otherwise("b")
    return ck.fill_pages(t.lineitem.select("l_orderkey", "l_linenumber", text.alias("text")), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "page")


@query("""with p as (select l_orderkey, list(l_linenumber + case when l_orderkey % 2 = 0 and l_linenumber > 2 then 1 else 0 end order by l_linenumber) as m from lineitem group by l_orderkey)
select l_orderkey, len(m)::int as n, m = range(m[1], m[1] + len(m)) as complete from p""")
def page_marker_sequences(t: Tables):
    page = F.col("l_linenumber") + F.when((F.col("l_orderkey") % 2 == 0) & (F.col("l_linenumber") > 2), 1).otherwise(0)  # in half of them one is missing
    text = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda n: F.concat(F.lit("Page "), n.cast("string"), F.lit("\nx"))), "\n")
    rows = t.lineitem.groupBy("l_orderkey").agg(ck.page_markers(text).alias("m"))
    return rows.select("l_orderkey", F.size("m").alias("n"), ck.markers_complete(F.col("m")).alias("complete"))


@query("""select o_orderkey, 'file_attr_' || substr(lower(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 48) || '_' || substr(sha256(o_orderpriority), 1, 10) as payload_key,
    substr(sha256(coalesce(nullif(array_to_string(list_sort(list_filter([case when o_orderstatus = 'O' then 'open' end, case when o_custkey % 2 = 0 then o_orderpriority end], lambda x: x is not null)), '|'), ''), 'default')), 1, 16) as bucket,
    'order_' || substr(sha256(o_orderkey || chr(31) || o_orderstatus), 1, 24) as id, sha256(o_orderpriority) as digest from orders""")
def identities(t: Tables):
    some = lambda c, v: F.array_compact(F.array(F.when(c, v)))
    return t.orders.select(
        "o_orderkey", hs.payload_key(F.col("o_orderpriority")).alias("payload_key"),
        hs.acl_bucket(some(F.col("o_orderstatus") == "O", F.lit("open")), some(F.col("o_custkey") % 2 == 0, F.col("o_orderpriority"))).alias("bucket"),
        hs.stable_id("order", F.col("o_orderkey"), F.col("o_orderstatus")).alias("id"), hs.sha256_text(F.col("o_orderpriority")).alias("digest"),
    )


@query("""with h as (select o_orderkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('order-' || o_orderkey)) as h from orders)
select o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (strpos('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] as uuid from h""")
def point_ids(t: Tables):
    return t.orders.select("o_orderkey", hs.uuid5(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"))).alias("uuid"))


_HASHED = "sha256(unhex(sha256(coalesce(text, ''))) || '\\x00\\x00\\x00\\x{k:02x}'::blob)"


@query(f"""with h as (select doc_id, {_HASHED.format(k=0)} || {_HASHED.format(k=1)} as h from documents), v as (select doc_id, [('0x' || h[2 * i + 1 : 2 * i + 2])::int / 127.5 - 1 for i in range(64)] as v from h),
n as (select doc_id, v, sqrt(list_sum([x * x for x in v])) as n from v) select doc_id, 64 as dimensions, round(v[1] / n, 6) as first, round(v[64] / n, 6) as last, round(list_sum([v[i] / n * i for i in range(1, 65)]), 5) as weighed from n""")
def hash_embeddings(t: Tables):
    e = t.documents.select("doc_id", hs.hash_embedding(F.col("text"), 64).alias("e"))
    weighed = F.aggregate(F.transform("e", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("doc_id", F.size("e").alias("dimensions"), F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.get("e", F.lit(63)), 6).alias("last"), F.round(weighed, 5).alias("weighed"))


@query("""with x as (select lower(p_name) as n, case p_partkey % 9 when 0 then 'README.md' when 1 then 'scan.pdf' when 2 then 'main.rs' when 3 then 'rows.csv' when 4 then 'app.log' when 5 then 'x.unknown' when 6 then 'notes.md' when 7 then '' else 'a.py' end as f, p_partkey from part)
select p_partkey, case when p_partkey % 50 = 0 then 'custom_v1' when f = 'notes.md' and p_partkey % 2 = 0 then 'pdf_markdown_external_v1' when f like '%.md' then 'markdown_docs_v1' when f = 'scan.pdf' then 'raw_pdf_research_v1' when f in ('main.rs', 'a.py') then 'code_repo_v1'
    when f = 'rows.csv' then 'tables_csv_json_v1' when f = 'app.log' then 'logs_errors_v1' when f = '' then 'tables_csv_json_v1' else 'markdown_docs_v1' end as mode from x""")
def mode_router(t: Tables):
    names = F.array(*[F.lit(x) for x in ("README.md", "scan.pdf", "main.rs", "rows.csv", "app.log", "x.unknown", "notes.md", "", "a.py")])
    f = F.get(names, (F.col("p_partkey") % 9).cast("int"))
    mode = usage.select_mode(f, F.when(f == "", "application/json"), F.when(F.col("p_partkey") % 50 == 0, "custom_v1"), (F.col("p_partkey") % 2 == 0) & (f == "notes.md"))
    return t.part.select("p_partkey", mode.alias("mode"))


@query(r"""select o_orderkey, case when o_orderkey % 4 = 0 then 'Smith' when o_orderkey % 4 = 1 then 'State' when o_orderkey % 4 = 2 then 'Matter ' || o_custkey else '' end as first_party,
    case when o_orderkey % 4 = 1 then 'Doe ' || o_custkey when o_orderkey % 4 = 0 then 'Jones' else '' end as second_party, case when o_orderkey % 4 = 3 then 0 when o_orderkey % 4 <= 1 then 2 else 1 end::int as n,
    case o_orderkey % 3 when 0 then 'REPEALS' when 1 then 'ADOPTS' else 'AMENDS' end as relation, (20000 + o_orderkey % 900)::varchar as number, case when o_orderkey % 2 = 0 then 'charter_ordinance' else 'ordinance' end as category
    from orders""")
def case_and_ordinance_names(t: Tables):
    k = F.col("o_orderkey")
    who = F.col("o_custkey").cast("string")
    title = F.when(k % 4 == 1, F.concat(F.lit("State  v. Doe "), who)).when(k % 4 == 2, F.concat(F.lit("In re  Matter "), who)).when(k % 4 == 0, "Smith v. Jones").otherwise("Nothing here")
    parties = tx.case_parties(title)
    verb = F.when(k % 3 == 0, "repealed by").when(k % 3 == 1, "adopting").otherwise("changed by")
    label = F.concat(F.when(k % 2 == 0, "Charter Ordinance No. ").otherwise("Ordinance No. "), (k % 900 + 20000).cast("string"))
    named = tx.ordinance_identity(label)
    return t.orders.select(
        "o_orderkey", F.coalesce(F.get(parties, 0), F.lit("")).alias("first_party"), F.coalesce(F.get(parties, 1), F.lit("")).alias("second_party"), F.size(parties).alias("n"),
        tx.ordinance_relation(verb).alias("relation"), named["number"].alias("number"), named["category"].alias("category"),
    )


@query(r"""select item_id, regexp_matches(q, '\b(cited by|citing|citations?|authorit(?:y|ies)|related (?:case|part)|same docket|overruled|precedent)\b', 'i') as intent,
    case when contains(lower(q), 'budget') then 'fiscal' when contains(lower(q), 'cited by') then 'courts' end as lens, q || case when contains(lower(q), 'springfield') then '' else ' Springfield' end as extended
    from (select item_id, case item_id % 3 when 0 then 'Who is cited by ' when 1 then 'Budget of Springfield ' else '' end || text as q from benchmark)""")
def graph_lenses(t: Tables):
    q = F.concat(F.when(F.col("item_id") % 3 == 0, "Who is cited by ").when(F.col("item_id") % 3 == 1, "Budget of Springfield ").otherwise(""), "text")
    lens = tx.infer_lens(q, {"fiscal": ["budget"], "grants": ["grant"], "courts": ["cited by"]}, ["fiscal", "courts"])
    return t.benchmark.select("item_id", tx.graph_intent(q).alias("intent"), lens.alias("lens"), tx.extend_query(q, [F.lit("Springfield"), F.lit(None).cast("string")]).alias("extended"))


@query(r"""select conv_id, turn, ltrim(right(text, 200)) as tail, regexp_replace(regexp_replace(regexp_replace(text, '^[ \t]+|[ \t]+$', '', 'gm'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as compact from conversations""")
def conversation_text(t: Tables):
    return t.conversations.select("conv_id", "turn", tx.last_chars(F.col("text"), 200).alias("tail"), tx.compact_lines(F.col("text")).alias("compact"))


@query(r"""with a as (select page_id, unnest(regexp_extract_all(html, '(<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>)', 1, 'is')) as a from pages)
select page_id, regexp_extract(a, 'href="([^"]*)"', 1, 'is') as href, trim(regexp_extract(a, '>([^<]*)</a>$', 1, 'is')) as label from a""")
def page_links(t: Tables):
    return readers.page_links(t.pages.select("page_id", "html"))


@query(r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, length(html) as n from pages")
def page_titles(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n"))


@query("""select page_id, 1 as n, '[[["k"],["' || page_id || '"]]]' as tables from pages""")
def html_tables(t: Tables):
    page = F.concat(F.lit("<table><tr><th>k</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td></tr></table>"), F.regexp_replace("html", "(?i)table", "tab"))
    rows = t.pages.select("page_id", py.html_tables(page).alias("tables"))
    return rows.select("page_id", F.size("tables").alias("n"), F.to_json("tables").alias("tables"))


@query()
def unicode_forms(t: Tables):
    return t.documents.select("doc_id", F.sha2(py.nfkc(F.col("text")), 256).alias("nfkc"), F.sha2(py.normalize_space(F.col("text")), 256).alias("page"))
