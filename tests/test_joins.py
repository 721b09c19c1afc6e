import random

import pytest

from eventloom.operators import asof as joins


def rows(seed, n=120):
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 0.6 else 1, rng.randrange(90), rng.randrange(1000)) for i in range(n)]


@pytest.mark.parametrize("slice_us", [5, 500, None])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, slice_us, strict):
    a, b = rows(1), rows(2)
    left, right = (spark.createDataFrame(x, "id long, k long, t long, v long") for x in (a, b))
    got = joins.asof(left, right, ["k"], "t", "t", {"hit": "id", "val": "v"}, tie="id", strict=strict, within_us=(0, 20), slice_us=slice_us).collect()
    assert len(got) == len(a)
    for r in got:
        ok = [x for x in b if x[1] == r.k and (x[2] < r.t if strict else x[2] <= r.t)]
        best = max(ok, key=lambda x: (x[2], x[0])) if ok else None
        if best and r.t - best[2] > 20:
            best = None
        assert (r.hit, r.val) == ((best[0], best[3]) if best else (None, None))


def test_previous_event_never_meets_itself(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, 5), (3, 0, 6)], "id long, k long, t long")
    got = {r.id: r.prev for r in joins.previous_event(df, ["k"], "t", {"prev": "id"}, tie="id", slice_us=2).collect()}
    assert got == {1: None, 2: None, 3: 2}


def test_nearest_exists_and_next(spark):
    a, b = rows(3, 60), rows(4, 40)
    left, right = (spark.createDataFrame(x, "id long, k long, t long, v long") for x in (a, b))
    near = {r.id: r.hit for r in joins.nearest_in_range(left, right, ["k"], "t", "id", "t", -4, 2, {"hit": "id"}, slice_us=7).collect()}
    seen = {r.id: r.any for r in joins.exists_in_range(left, right, ["k"], "t", "t", -4, 2, "any").collect()}
    after = {r.id: r.nxt for r in joins.next_after(left, right, ["k"], "t", "t", "nxt", slice_us=7).collect()}
    for i, k, t, _ in a:
        ok = [x for x in b if x[1] == k and -4 <= x[2] - t <= 2]
        best = min(ok, key=lambda x: (abs(x[2] - t), x[0])) if ok else None
        assert near[i] == (best[0] if best else None)
        assert seen[i] == bool(ok)
        assert after[i] == min((x[2] for x in b if x[1] == k and x[2] > t), default=None)


def test_pairs_and_keep_last(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (2, 1, "z"), (3, 1, "p"), (3, 2, "q"), (3, 3, "r")], "pid long, t long, s string")
    got = joins.pair_by_id(df, "pid", ["t"], {"s": "s"}).collect()
    assert [(r.pid, r.a_s, r.b_s) for r in got] == [(1, "y", "x")]
    last = {r.pid: r.s for r in joins.keep_last(df, ["pid"], F.col("t")).collect()}
    assert last == {1: "x", 2: "z", 3: "r"}
