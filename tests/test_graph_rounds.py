"""Decisions' texts are read once for nodes and edges; levels of a tree are written once and no level reads another's rows again."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import graph as gr


def test_a_decisions_text_is_read_once_for_nodes_and_edges(spark):
    text = "See State v. Roe, 12 Kan. 5. Under K.S.A. 21-5 and Rule 183, No. 99,123."
    rows = [(1, "State v. Doe", 7, "Court", 1999, None, text), (2, "In re Doe", None, "Court", 2000, "P", None)]
    nodes, edges = gr.decision_graph(spark.createDataFrame(rows, "document_id long, title string, docket_number long, court string, decision_year int, status string, text string"))
    for df in (nodes, edges):
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    kinds = {(r.type, r.label) for r in nodes.collect()}
    assert kinds >= {("opinion", "State v. Doe"), ("docket", "7"), ("court", "Court"), ("year", "1999"), ("year", "2000"), ("status", "P"), ("party", "Doe"), ("rule", "183"), ("docket", "99123")}
    ends = {r.id for r in nodes.collect()}
    assert all(r.source in ends and r.target in ends for r in edges.collect())
    assert {r.type for r in edges.where(F.col("type").startswith("CITES")).collect()} == {"CITES_CASE_CITATION", "CITES_STATUTE", "CITES_RULE", "CITES_DOCKET"}


def test_levels_of_a_tree_are_written_once(spark):
    rows = spark.range(40).selectExpr("id", "if(id = 0, null, id - 1) as parent", "0 as ordinal", "'x' as content", "cast(id as int) as level")
    plan = gr.subtree_hashes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "sha2" not in plan
