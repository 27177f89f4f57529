"""Every registered query on the smallest given tables, against its SQL where it has one."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# the models need more conversations than the smallest tables hold
MODEL_SF_DIR = os.environ.get("TEST_MODEL_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()


def sf_dir_of(name):
    return MODEL_SF_DIR if name.endswith(("_quality", "_importance")) else SF_DIR


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in {SF_DIR, MODEL_SF_DIR}:
        found[folder] = duckdb.connect()
        for name in TABLES:
            found[folder].sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    return value


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, sf_dir_of(name))
    relation = duck[sf_dir_of(name)].sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert not any("HUGE" in str(t) or "DECIMAL" in str(t) for t in relation.types)
    cols = sorted(df.columns)
    got = ordered([tuple(plain(r[c]) for c in cols) for r in df.collect()])
    at = [relation.columns.index(c) for c in cols]
    want = ordered([tuple(plain(r[i]) for i in at) for r in relation.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    df = QUERIES[name](spark, MODEL_SF_DIR)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
