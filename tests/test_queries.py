"""Every registered query against its DuckDB SQL, over whole tables; queries without SQL must run and have rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from lingmill.queries import ORACLES, QUERIES

SF = os.environ.get("QUERIES_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: no rows where nothing stands out, or few
MAY_BE_EMPTY = {"r14_correlation_filter", "a22_interaction_by_strata", "a16_topics_without_duplicates", "x6_examples"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 2")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, Decimal)):
        return None if math.isnan(x) else float(f"{float(x):.6g}") + 0.0
    return str(x)


def kind(x):
    return "number" if isinstance(x, float) else type(x).__name__


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in data]
    return sorted(names), sorted(out, key=lambda r: tuple((x is None, kind(x), x if x is not None else 0) for x in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got or name in MAY_BE_EMPTY
        return
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want_names, want = rows(names, cursor.fetchall())
    have_names, have = rows(df.columns, got)
    assert have_names == want_names
    assert len(have) == len(want)
    off = [(h, w) for h, w in zip(have, want) if not all(map(close, h, w))]
    assert not off, f"{len(off)} of {len(want)} rows differ: {off[:3]}"
