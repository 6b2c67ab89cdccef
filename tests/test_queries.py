"""Every query outside llm runs on the smallest tables, and agrees with its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from stratalog.plans import core_problems, fleet, misc, people, session, streams, transcripts, vault

SF = os.environ.get("STRATALOG_TEST_SF", "/root/testdata/sf0.001")
PLANS = [core_problems, fleet, people, transcripts, session, vault, misc, streams]
QUERIES = {n: f for p in PLANS for n, f in p.QUERIES.items()}
ORACLES = {n: s for p in PLANS for n, s in p.ORACLES.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return tuple(sorted((k, plain(v)) for k, v in value.items())) if isinstance(value, dict) else value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        name, at = f.removesuffix(".parquet"), f"{SF}/{f}"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees(spark, sql, name):
    df = QUERIES[name](spark, SF)
    cur = sql.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    want = Counter(repr(plain([r[i] for i in at])) for r in cur.fetchall())
    assert Counter(repr(plain(list(r))) for r in df.collect()) == want


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == QUERIES["wall_by_tool"](spark, SF).columns
    assert set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
