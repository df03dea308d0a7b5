"""Every query of the registry against its SQL, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as registry
from marlstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: HTML is parsed in Python, full names are patterns made of columns; tests/test_search.py has the parser's results.
NO_SQL = {"crawl_report", "html_extract", "entity_verdict"}


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def sql(tiny):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sql, tiny, name):
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in NO_SQL:
        assert got
        return
    said = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in said.fetchall())


def test_entry_has_rows(spark):
    assert 0 < registry.entry(spark).count() <= 5
