"""Registered queries against their SQL on the smallest tables (all of them with EVENTLOOM_ALL=1)."""

import math
import os
import sys

import pytest

sys.path.append("/opt/oracle")
duckdb = pytest.importorskip("duckdb")

from eventloom.plans import catalog  # noqa: E402

FOLDER = os.environ.get("EVENTLOOM_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["b1_strictly_before", "w14_push_delay_state", "w19_occupancy_queue", "w23_workload", "j05_asof_with_ties", "j11_nearest_in_range", "a05_time_forward_floor", "d05_tail_metrics", "m02_group_ols"]
NAMES = sorted(catalog.SQL) if os.environ.get("EVENTLOOM_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def cell(v):
    return (v is None, str(v) if not isinstance(v, (int, float)) else "", round(float(v), 6) if isinstance(v, (int, float)) and not math.isnan(v) else 0.0)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    rel = con.execute(catalog.SQL[name])
    names = [d[0] for d in rel.description]
    order = sorted(names)
    want = sorted(tuple(cell(r[names.index(c)]) for c in order) for r in rel.fetchall())
    df = catalog.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == order
    got = sorted(tuple(cell(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert x[:2] == y[:2] and math.isclose(x[2], y[2], rel_tol=1e-6, abs_tol=1e-6), (a, b)


def test_every_query_has_a_description():
    import eventloom.plans.registry as registry

    assert all(fn.__doc__ for fn in registry.QUERIES.values())
    assert set(catalog.SQL) <= set(catalog.QUERIES)
