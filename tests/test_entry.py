"""Registered queries against their SQL, and the shapes' expected numbers of rows."""

import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")

import __spark_entry__ as E  # noqa: E402
from tessera import queries as Q  # noqa: E402

ROWS = {"bgp_P2": 1315, "bgp_P3": 12167, "bgp_T2": 1298, "bgp_TI2": 1318, "bgp_Tr1": 812, "bgp_Tr2": 820, "bgp_S1": 7478, "bgp_S4": 7283, "tp_self_loop": 9, "wd_C1": 627, "wd_C2": 2710, "wd_S3": 339, "bgp_cartesian": 200}
SLOW = {"bgp_P3", "bgp_P4", "bgp_T3", "bgp_T4", "bgp_TI3", "bgp_TI4", "bgp_J3", "bgp_J4", "bgp_S2", "bgp_S3", "bgp_S4", "wcoj_square"}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert E.entry(spark).columns == ["o", "c", "n"] and E.entry(spark).count() == 1500


def test_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries()) and len(Q.queries()) > 80 and set(Q.oracle_sql()) == set(Q.queries())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - SLOW))
def test_against_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*(f"`{c}`" for c in want.columns)).collect()
    tidy = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert Counter(map(tidy, got)) == Counter(map(tidy, want.fetchall()))
    if name in ROWS:
        assert len(got) == ROWS[name]
