"""Every query with SQL gives the rows that another engine gets from that SQL."""

import math
import os

import duckdb
import pytest

from partloom.plans.oracles import ORACLES
from partloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.12g}")
        return x

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = canonical(tuple(r[c] for c in names) for r in df.collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    order = [rel.columns.index(c) for c in names]
    want = canonical(tuple(r[i] for i in order) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
    assert want, "an empty comparison shows nothing"
