"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf, t)}.parquet'")
    return c


def rows(df, columns):
    plain = lambda x: repr(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else "-" if x is None or x != x else str(x)
    return sorted(tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf)
    if name not in SQL:
        assert found.count() > 0
        return
    want, got = duck.execute(SQL[name]).df(), found.toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="module")
def tied(spark, sf, tmp_path_factory):
    """Tables with copies of texts and vectors: many equal scores, and ids whose order is not that of their files."""
    import numpy as np

    d = str(tmp_path_factory.mktemp("tied"))
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"COPY (SELECT * FROM '{os.path.join(sf, t)}.parquet') TO '{d}/{t}.parquet'")
    texts = ["the license has a version"] * 30 + ["license version license"] * 3 + ["nothing of it here"] * 67
    docs = c.execute(f"SELECT * FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT 100").df()
    docs["text"], docs["doc_id"], docs["source"], docs["lang"] = texts, np.arange(100, dtype=np.int64), [f"src{(i * 7) % 5}" for i in range(100)], "en"
    c.execute(f"COPY (SELECT e.vec_id, f.embedding, e.label FROM '{sf}/embeddings.parquet' e JOIN '{sf}/embeddings.parquet' f ON f.vec_id = e.vec_id % 4 WHERE e.vec_id < 100) TO '{d}/embeddings.parquet'")
    c.execute(f"COPY (SELECT * FROM docs) TO '{d}/documents.parquet'")
    return d


@pytest.mark.parametrize("name", ["hybrid_search", "workspaces_search"])
def test_ties(spark, tied, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tied}/{t}.parquet'")
    want, got = c.execute(SQL[name]).df(), QUERIES[name](spark, tied).toPandas()
    assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns)) and len(got) == 10
