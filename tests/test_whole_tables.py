"""Queries over whole tables: no row of an input is left out, in the query and in its SQL."""

import pytest

from millrace.plans.queries import QUERIES, SQL, edges


def test_enclosing_nodes(spark):
    sf = "/root/testdata/sf0.01"
    assert QUERIES["enclosing_nodes"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count() > 2000


def test_edges(spark, sf):
    assert edges(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


@pytest.mark.parametrize("cut", ["l_shipdate", "event_id <", "doc_id <", "LIMIT 1000"])
def test_sql_has_no_cuts(cut):
    assert not [n for n, s in SQL.items() if cut in s]
