"""Every registered query with SQL against DuckDB on the same tables."""

import math

import duckdb
import pytest

from assaykit.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 6) + 0.0
    return int(value) if isinstance(value, bool) else value


def rows(names, records):
    return sorted(repr(tuple(plain(r[n]) for n in sorted(names))) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    records = [r.asDict() for r in got.collect()]
    assert len(set(got.columns)) == len(got.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == sorted(got.columns)
        floats = lambda xs: [[float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in x] for x in xs]
        a = rows(got.columns, [dict(zip(r, v, strict=True)) for r, v in zip(records, floats(r.values() for r in records), strict=True)])
        b = rows(want.columns, [dict(zip(want.columns, v, strict=True)) for v in floats(want.fetchall())])
        assert a == b


def test_entry_runs_without_the_corpus_operators():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert all(callable(f) for f in e.queries().values())
