"""Every registered query against its SQL counterpart on the smallest data folder."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, "" if v is None else (v if not isinstance(v, float) or not math.isnan(v) else math.inf)) for v in row)


def ordered(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(rows, df.columns) == ordered(res.fetchall(), names)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() == 1
