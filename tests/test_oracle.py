"""Queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from wakeline.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
    cur = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    other = [tuple(_plain(r[theirs.index(c)]) for c in names) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(other, key=key)


#: Queries without a twin; tests/test_brute.py, and tests/test_more.py for the last, hold their operators against plain Python.
BRUTE = {"matches", "balance", "match_observability", "outcomes", "match_components", "match_differences", "outcome_intervals", "injections", "case_selection", "geojson_points", "geojson_cells", "geojson_tracks", "hotspot_card_cases"}


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLE_SQL) == BRUTE
