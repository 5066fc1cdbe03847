"""Every registered query with oracle SQL matches DuckDB at sf0.001; the rest run."""

import os

import duckdb
import pytest

from conftest import SF001

TABLES = [f.removesuffix(".parquet") for f in os.listdir(SF001) if f.endswith(".parquet")]


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    norm = [repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows]
    return len(rows), [cols[i] for i in order], sorted(norm)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_all_queries_sf0001(spark, duck):
    import __spark_entry__ as entry
    qs, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(qs)
    bad = []
    for name, fn in qs.items():
        df = fn(spark, SF001)
        rows = [tuple(r) for r in df.collect()]
        if name not in oracle:
            continue
        res = duck.execute(oracle[name])
        if _digest(df.columns, rows) != _digest([d[0] for d in res.description], res.fetchall()):
            bad.append(name)
    assert not bad, bad
