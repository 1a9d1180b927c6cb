"""Every registered query of the engine against its SQL oracle."""

import glob
import os

import duckdb
import pytest

from tidemark import plans

FOLDER = "/root/testdata/sf0.001"
SKIP = {"external_values_check", "linearizable_keys", "command_outcomes", "cache_evictions"}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_all_but_four_have_an_oracle():
    assert set(plans.QUERIES) - set(plans.ORACLES) == SKIP
    assert len(plans.QUERIES) >= 122


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - SKIP))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, FOLDER)
    want = duck.execute(plans.ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())
