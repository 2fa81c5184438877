"""Every query that has SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ebbline import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    result = oracle.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, result.fetchall())


def test_greedy_batches_against_a_loop(spark):
    found = {(r.span, r.seq): r for r in QUERIES["bat1_greedy_batches"](spark, SF).collect()}
    batch, count, n, size, span = 0, 0, 0, 0, None
    for key in sorted(found):
        r = found[key]
        if r.span != span:
            span, batch, count, n, size = r.span, 0, 0, 0, 0
        if count and (n + r.n_rows > 100 or size + r.cost > 20_000):
            batch, count, n, size = batch + 1, 0, 0, 0
        assert r.batch == batch
        count, n, size = count + 1, n + r.n_rows, size + r.cost
        if count >= 8 or n >= 100 or size >= 20_000:
            batch, count, n, size = batch + 1, 0, 0, 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
