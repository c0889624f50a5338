"""Walks over deep graphs, readers and sinks over files, stores, page models and the helpers that no query of the catalogue has."""

import csv
import hashlib
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from brindle.functions import hashing as hs
from brindle.functions import python as py
from brindle.operators import chunking as ck
from brindle.operators import code_pages as cp
from brindle.operators import context as cx
from brindle.operators import evidence as ed
from brindle.operators import filters as fl
from brindle.operators import graph as gr
from brindle.operators import ingest as ig
from brindle.operators import retrieval as rt
from brindle.operators.security import Principal
from brindle.sources import readers, sinks
from brindle.streaming import jobs


def test_parents_of_seventy_levels(spark):
    rows = [("m", i, i % 70 if i < 210 else 69) for i in range(260)] + [(None, 0, 3), (None, 1, 5), ("x", 0, None)]
    got = {(r.g, r.i): r.parent_position for r in gr.manifest_parents(spark.createDataFrame(rows, "g string, i int, level int"), "g", "i", "level").collect()}
    assert len(got) == len(rows)
    for g, i, level in rows:
        above = [j for h, j, k in rows if h == g and j < i and level is not None and k is not None and k < level]
        assert got[g, i] == (max(above) if above else None), (g, i)


def test_ancestors_of_a_deep_chain_with_a_cycle_and_a_diamond(spark):
    n = 300
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("a", "b"), ("b", "a"), ("d", "l"), ("d", "r"), ("l", "t"), ("r", "t")]
    nodes = spark.createDataFrame([(x,) for e in edges for x in e], "id string").distinct()
    up = gr.ancestors(nodes, spark.createDataFrame(edges, "id string, parent string"), 400)
    got = {(r.id, r.ancestor): r.distance for r in up.collect()}
    want = {(f"c{i}", f"c{j}"): i - j for i in range(n) for j in range(i)}
    want |= {("a", "b"): 1, ("b", "a"): 1, ("d", "l"): 1, ("d", "r"): 1, ("l", "t"): 1, ("r", "t"): 1, ("d", "t"): 2}
    assert got == want
    near = gr.ancestors(nodes.where("id = 'c299'"), spark.createDataFrame(edges, "id string, parent string"), 16)
    assert sorted(r.distance for r in near.collect()) == list(range(1, 17))


def test_more_than_a_million_ancestors(spark):
    parents = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 25 != 0, F.col("id") - 1).alias("parent")).where("parent is not null")
    wide = parents.unionByName(parents.select((F.col("id") + 100_000).alias("id"), (F.col("parent") + 100_000).alias("parent")))
    up = gr.ancestors(wide.select("id"), wide, 30)
    assert up.count() == 2 * (60_000 // 25) * sum(range(25))


def test_walks_down_and_crawls_in_rounds(spark):
    edges = [(f"n{i}", f"n{i + 1}", "CONTAINS") for i in range(30)] + [("n30", "n0", "CONTAINS"), ("n0", "m", "OTHER")]
    down = gr.descendants(spark.createDataFrame([("n0",)], "id string"), spark.createDataFrame(edges, "source string, target string, type string"), 40)
    assert {(r.id, r.distance) for r in down.collect()} == {(f"n{i}", i) for i in range(1, 31)}
    links = spark.createDataFrame([(a, b) for a, b, _ in edges], "source string, target string")
    seeds = spark.createDataFrame([("n0",), ("n0",)], "url string")
    assert {(r.url, r.depth) for r in readers.crawl(seeds, links, 12).collect()} == {("n0", 0), ("m", 1), *((f"n{i}", i) for i in range(1, 13))}
    assert len(gr.descendants(seeds.withColumnRenamed("url", "id"), links.withColumn("type", F.lit("CONTAINS")), 24)._jdf.queryExecution().toString()) < 100_000


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ"):
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "v.jsonl").write_text('{"kind": "a", "n": 1}\n\n{"other": [1]}\n')
    rows = readers.variant_lines(spark, str(tmp_path / "v.jsonl")).select(F.variant_get("record", "$.n", "int").alias("n"))
    assert [r.n for r in rows.collect()] == [1, None]
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbfcode,name\n1, Ann \n2,Bo\n")
    assert [tuple(r) for r in readers.csv_manifest(spark, str(tmp_path / "m.csv"), "code int, name string").collect()] == [(1, "Ann"), (2, "Bo")]
    m = spark.createDataFrame([(1, "https://code.example/TMC/a#x"), (2, "https://code.example/TMC/a"), (3, "https://else.example/b")], "line int, url string")
    assert [(r.line, r.canonical_url) for r in readers.url_manifest(m, "https://code.example").collect()] == [(1, "https://code.example/TMC/a")]
    files = readers.objects(spark, str(tmp_path), "m.csv")
    digest = hashlib.sha256((tmp_path / "m.csv").read_bytes()).hexdigest()
    assert files.first().sha256 == digest
    records = spark.createDataFrame([(digest, "r1"), ("0", "r2")], "sha256 string, record_id string")
    assert [r.record_id for r in readers.custody_objects(files, records, 1 << 20).collect()] == ["r1"]
    assert readers.custody_objects(files, records, 3).count() == 0
    c = spark.createDataFrame([("u1", "<p>hello there</p>", None), ("u2", None, "f"), (None, "<p>x</p>", None), ("u4", None, "gone")], "url string, html string, path string")
    got = {r.url: (r.body, r.error) for r in readers.captures(c, spark.createDataFrame([("f", "<p>file</p>")], "path string, text string")).collect()}
    assert got == {"u1": ("<p>hello there</p>", None), "u2": ("<p>file</p>", None), None: ("<p>x</p>", "no url"), "u4": (None, "no body")}
    s = readers.settings(spark, {"a": {"k": 4}, "b": {}}).select("id", F.variant_get("value", "$.k", "int").alias("k"))
    assert {tuple(r) for r in s.collect()} == {("a", 4), ("b", None)}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "i")
    chunks = spark.createDataFrame([(1, "red fox fox"), (2, "red hen")], "chunk_id long, text string")
    sinks.index(rt.postings(chunks), at, 4)
    assert {(r.term, r.chunk_id, r.tf) for r in spark.read.parquet(at).collect()} == {("red", 1, 1), ("fox", 1, 2), ("red", 2, 1), ("hen", 2, 1)}
    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 10)), (2, datetime(2024, 1, 2, 10))], "id int, ts timestamp")
    for _ in range(2):
        sinks.append_events(e, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).where("day = '2024-01-02'").count() == 2
    for k in (1, 2):
        sinks.state(spark.createDataFrame([(k,)], "n int"), str(tmp_path / "s"))
    assert [r.n for r in spark.read.json(str(tmp_path / "s")).collect()] == [2]


def test_a_store_shows_each_caller_what_they_may_read(spark, tmp_path):
    text = "# One\nThe red fox runs over the hill.\n# Two\nA blue hen sleeps in the barn."
    row = lambda i, t, v=1, level=1, groups=(), tenant="t", active=True: (i, t, v, tenant, "i", active, level, list(groups), [])
    docs = [row(1, text), row(2, text + " copy"), row(3, text), row(4, "An old fox text.", 1), row(4, "A newer text on the grey fox.", 2), row(5, "Secret fox plans.", level=3), row(6, "Fox of the group.", groups=["g"]), row(7, "Fox elsewhere.", tenant="u"), row(8, "Gone fox.", active=False)]
    table = spark.createDataFrame(docs, "document_id long, text string, version int, tenant_id string, instance_id string, active boolean, level int, groups array<string>, roles array<string>")
    counts = ig.ingest(table, str(tmp_path / "store")).first()
    assert (counts.documents, counts.chunks) == (7, 9)
    q = spark.createDataFrame([(1, "fox")], "query_id long, text string")
    seen = lambda p: {r.document_id for r in ig.stored_search(spark, str(tmp_path / "store"), q, 20, p).collect()}
    assert seen(Principal("t", "i", max_level=1)) == {1, 2, 4}
    assert seen(Principal("t", "i", ("g",), max_level=3)) == {1, 2, 4, 5, 6}
    assert seen(Principal("u", "i")) == {7} and seen(Principal("t", "other")) == set()
    new = [r.text for r in ig.stored_search(spark, str(tmp_path / "store"), q, 20, Principal("t", "i")).where("document_id = 4").collect()]
    assert new == ["A newer text on the grey fox."]


def test_equal_vectors_do_not_fill_a_batch(spark):
    chunks = spark.range(5000).select(F.col("id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    q = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "query_id long, embedding array<double>")
    got = rt.dense_search(q, chunks, 3).collect()
    assert {(r.query_id, r["rank"], r.chunk_id) for r in got} == {(i, k + 1, k) for i in range(20) for k in range(3)}


def test_code_pages(spark):
    root = "https://code.example/TMC"
    section = """<html><head><title>t</title></head><body><nav><h1>Menu</h1></nav><main><h1>Municipal code</h1><h2>2.10.040 Duties &amp; terms</h2><script>x</script>
      <p>“Clerk” or officer means the city clerk.</p><p>It acts by day.</p><p>“Court” means the court.</p><p>(Ord. 20123 § 4, 3-1-2019; Ord. 20124.)</p>
      <p>See <a href="/TMC/2.10.050#b">2.10.050</a> and <a href="https://else.example/x">else</a>.</p><p>The Topeka Municipal Code is current through Ordinance 20500, passed June 1, 2024.</p><p>Privacy Policy</p><p>not this</p></main></body></html>"""
    pages = [(f"{root}/2.10.040?x=1", section), (root, f"<main><h1>CODE</h1><a href='{root}/02/'>Title 2</a><a href='/TMC/2.10.040'>deep</a></main>"), (f"{root}/02", "<main><h1>Title 2 Administration</h1><a href='/TMC/2.10.040'>s</a></main>"), ("https://else.example/x", "<p>no</p>"), (f"{root}/empty", None)]
    model = cp.page_model(spark.createDataFrame(pages, "url string, html string"), root).cache()
    m = {r.url.removeprefix(root): r for r in model.collect()}
    assert {k: (r.kind, r.citation, r.title) for k, r in m.items()} == {"/2.10.040": ("section", "2.10.040", "Duties & terms"), "": ("code", None, "CODE"), "/02": ("title", "2", "Administration"), "/empty": ("listing", None, "empty")}
    assert (m["/2.10.040"].version, m["/2.10.040"].version_date) == ("20500", "June 1, 2024") and m["/2.10.040"].links == [f"{root}/2.10.050"]
    assert {(r.term, r.alias, r.text) for r in cp.definitions(model).collect()} == {("Clerk", "officer", "“Clerk” or officer means the city clerk.\n\nIt acts by day."), ("Court", None, "“Court” means the court.")}
    assert {(r.ordinance, r.section, r.date) for r in cp.history(model).collect()} >= {("20123", "4", "3-1-2019"), ("20124", None, None)}
    nodes, edges = cp.code_graph(model)
    name = {r.id: (r.type, r.label) for r in nodes.collect()}
    got = {(r.type, name[r.source][1], name[r.target][1]) for r in edges.collect()}
    assert {e for e in got if e[0] == "CONTAINS"} == {("CONTAINS", "CODE", "2 Administration"), ("CONTAINS", "2 Administration", "2.10.040 Duties & terms"), ("CONTAINS", "CODE", "empty")} - {("CONTAINS", "CODE", "empty")}
    assert ("REFERENCES", "2.10.040 Duties & terms", "2.10.050") in got and ("DEFINES", "2.10.040 Duties & terms", "Court") in got


def test_evidence_that_does_not_hold(spark):
    text = "<!-- page 1 -->\na\nb é\n<!-- page 2 -->\nlast"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    row = lambda t=text, n=2, page=1, a=2, b=2, own=False, q="b é", digest=None: (t, digest or sha(t), n, page, a, b, own, q, sha(q))
    cases = [
        (row(), None), (row(page=2, a=1, b=1, q="last"), None), (row(own=True, a=3, b=3), None), (row(a=1, b=2, q="a\nb é"), None), (row(digest="0"), "text digest"), (row(t=text + "\r", digest=None), "carriage returns"),
        (row(page=3), "bounds"), (row(n=3), "page marks"), (row(t=text + "<!--page 9 -->"), "malformed page marks"), (row(a=2, b=9), "lines"), (row(q="b e"), "quote"),
    ]
    schema = "text string, text_sha256 string, page_count int, page int, line_start int, line_end int, marker_is_line_one boolean, quote string, quote_sha256 string"
    got = ed.page_lines(spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(cases)], "i int, " + schema)).orderBy("i").collect()
    assert [r.failure for r in got] == [why for _, why in cases]
    for r in got:
        if r.failure is None:
            assert r.text[r.char_start : r.char_end] == r.quote and r.text.encode()[r.byte_start : r.byte_end].decode() == r.quote


def test_csv_records_of_whole_files(spark):
    content = b'\xef\xbb\xbfa,b\n1,"x\ny"\n2,z\n'
    rows = list(csv.reader(content.decode("utf-8-sig").splitlines(keepends=True)))
    digest = lambda v: hashlib.sha256(json.dumps({"headers": rows[0], "values": v}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    sources = spark.createDataFrame([(k, bytearray(content if k != 3 else b"a,a\n1,2\n"), hashlib.sha256(content if k != 3 else b"a,a\n1,2\n").hexdigest()) for k in range(4)], "source_id int, content binary, sha256 string")
    refs = [(0, 1, digest(rows[1])), (0, 2, digest(rows[2])), (1, 5, digest(rows[1])), (2, 2, digest(rows[1])), (3, 1, "x")]
    got = {(r.source_id, r.record): (r.failure, r.line_end) for r in ed.csv_records(sources, spark.createDataFrame(refs, "source_id int, record int, record_sha256 string")).collect()}
    assert got == {(0, 1): (None, 3), (0, 2): (None, 4), (1, 5): ("missing records", None), (2, 2): ("digest of record 2", None), (3, 1): ("header", None)}


def test_helpers(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert one(hs.canonical_digest(F.lit('{"b": 1, "a": [2], "at": 9}'), ["at"]).alias("x")).x == hashlib.sha256(b'{"a":[2],"b":1}').hexdigest()
    assert one(py.sanitize_json(F.lit('{"password": "x", "n": 1}')).alias("x")).x is None
    assert json.loads(one(py.sanitize_json(F.lit('{"n": [{"who": "a@b.co", "k": 1}]}')).alias("x")).x) == {"n": [{"who": "[REDACTED]", "k": 1}]}
    assert fl.merge_filters({"a": 1}, {"a": 2, "b": 3}) == {"a": 1, "b": 3} and fl.merge_filters(None, None) == {}
    docs = spark.createDataFrame([(1, "<!-- page: 4 -->\n# H\nbody"), (2, None), (3, "")], "id int, text string")
    got = ck.chunk_documents(docs, ["id"], mode="pdf_markdown_external_v1").collect()
    assert {(r.id, r.page, r.kind) for r in got} == {(1, 4, "pdf_markdown")}
    law = "# 12-101. Powers\nSource: <https://x.example/12-101>\n\n(a) First.\n\n(b) Second.\n\n## History\nL. 1923"
    got = [(r.text, r.kind, r.heading_path) for r in ck.chunk_documents(spark.createDataFrame([(law,)], "text string"), [], mode="statute_v1").orderBy("ordinal").collect()]
    assert got == [("(a) First.", "statute_body", ["12-101. Powers"]), ("(b) Second.", "statute_body", ["12-101. Powers"]), ("L. 1923", "statute_metadata", ["12-101. Powers", "history"])]
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([4, 4, 4, 9, 1, 1, 1])], "k string, i int, n int")
    assert [r.batch for r in ck.plan_batches(rows, "k", "i", F.col("n"), 8, 3).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 3]
    many = spark.range(3).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.concat(F.lit("# h\nt "), i)), "\n").alias("text"))
    assert ck.chunk_documents(many, ["id"]).groupBy("id").count().where("count = 3000").count() == 3


def test_definitions_of_each_language():
    for line, name in (
        ("def run(x):", "run"), ("    async def go():", "go"), ("class Tree(Base):", "Tree"), ("export default function main() {", "main"), ("export const add = (a, b) => a + b", "add"), ("let f = async x => x", "f"),
        ("export abstract class A {", "A"), ("interface Shape {", "Shape"), ("func Serve(w int) error {", "Serve"), ("func (s *Server) Close() {", "Close"), ("pub fn new() -> Self {", "new"), ("pub(crate) struct P;", "P"),
        ("impl<T> Tree<T> {", "Tree"), ("enum Color {", "Color"), ("public class Main {", "Main"), ("  private static int count(String s) {", "count"), ("public sealed interface Node {", "Node"), ("override fun draw() {", "draw"),
        ("return x", None), ("definition = 3", None), ("x = call(y)", None), ("const limit = 4", None), ("classes are", None), ("# def f", None),
    ):
        assert ck.symbol_of(line) == name, line


def test_expansions_keep_a_chunk_at_its_first_place(spark):
    cols = "query_id int, chunk_id string, text string, rank int, ordinal int"
    hits = spark.createDataFrame([(1, "a", "A", 1, 5), (1, "b", "B", 2, 9)], cols)
    parents = spark.createDataFrame([(1, "p", "P", 1, 4)], cols).withColumn("relation", F.lit("parent_section"))
    near = spark.createDataFrame([(1, "n", "N", 1, 6), (1, "b", "B", 1, 7), (1, "p", "P", 2, 4)], cols).withColumn("relation", F.lit("neighbor"))
    got = [(r.chunk_id, r.relation) for r in cx.merge_expansions(hits, parents, near).orderBy("position").collect()]
    assert got == [("a", "direct"), ("p", "parent_section"), ("n", "neighbor"), ("b", "direct")]


def test_activity_expires(spark, tmp_path):
    for n, rows in enumerate([[(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], [(1, datetime(2024, 1, 20))], [(3, datetime(2024, 3, 1))], [(3, datetime(2024, 3, 2))]]):
        spark.createDataFrame(rows, "store_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = jobs.expire(spark.readStream.schema("store_id long, ts timestamp").parquet(str(tmp_path / "in")), 10)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        assert q.awaitTermination(120)
    got = {(r.store_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, "active"), (2, "active"), (3, "active"), (1, "expired"), (2, "expired")} <= got and (3, "expired") not in got
