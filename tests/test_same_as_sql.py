"""Queries on small tables on which they once gave other rows than their SQL."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest


@pytest.fixture
def same(spark, sf, tmp_path):
    """same(name, table=(rows of SQL)): whether a query gives the rows of its SQL; tables that aren't given are the smallest ones."""

    def check(name: str, **tables: str) -> list[tuple]:
        con = duckdb.connect()
        for t in ("customer", "orders", "lineitem", "part", "events", "documents", "benchmark", "embeddings"):
            at = f"{tmp_path}/{t}.parquet"
            con.execute(f"copy ({tables.get(t, f'select * from base')}) to '{at}'".replace(" base", f" read_parquet('{sf}/{t}.parquet')"))
            con.execute(f"create view {t} as select * from read_parquet('{at}')")
        df = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
        return got

    return check


def test_gauges_take_the_nearest_second(same):
    rows = "select * replace (date_trunc('second', ts) + interval 700 millisecond as ts) from base"
    assert same("gauges", events=rows)[0][3] % 60 == 17  # 23:26:16.7


def test_of_links_made_at_once_the_first_stored_counts(same):
    rows = "select * replace (timestamp '2020-01-01' as l_shipdate, 1 as l_linenumber, row_number() over () as l_suppkey) from base"
    assert same("hydrate_hits", lineitem=rows)


def test_all_profiles_that_share_the_best_score_are_selected(same):
    rows = "select i as p_partkey, ['a', 'b', 'c'][i % 3 + 1] as p_brand, case when i % 3 = 2 then 26 else 40 end as p_size from range(12) t(i)"
    assert sorted((r[0], r[2]) for r in same("bakeoff_selection", part=rows)) == [("a", True), ("b", True), ("c", False)]
