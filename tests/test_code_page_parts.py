"""Pages are read by as many tasks as a shuffle has, however small the table is that they come from; parts are found with their tags."""

from __future__ import annotations

from brindle.operators import code_pages as cp
from brindle.plans import audit_plans as ap
from brindle.plans.registry import Tables


def test_orders_are_dealt_before_they_are_pages(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(ap, "cut", lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    ap.code_page_graph(Tables(spark, sf))
    assert seen[0].count("RepartitionByExpression") == 2


def test_parts_and_tags(spark):
    page = "<main><H2 class='a>'>Title 1 One</h2><P\nid=x>one &amp; <b>two</b><p>three<ul><li>four</ul><p>Privacy Policy</p><p>gone</p></main>"
    r = cp.page_model(spark.createDataFrame([("https://x.example/TMC/t1", page), ("https://x.example/TMC/t2", None)], "url string, html string"), "https://x.example/TMC").orderBy("url").collect()
    assert [(b.tag, b.text) for b in r[0].blocks] == [("p", "one & two"), ("p", "three"), ("li", "four")]
    assert (r[0].heading, r[1].heading, r[1].blocks) == ("'>Title 1 One", "t2", [])
