"""Frames against brute force, with slices and chunks far smaller than the data."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators.rowframes import over_rows, previous_row_windows
from eventloom.operators.scan import islands, run_length, since_change, workload
from eventloom.operators.slices import Running, running, time_slice, value_slice, with_position
from eventloom.operators.timeline import Feature, before, between_open, closed, events, over_range, trailing, until


def sample(seed, n=150, span=200, keys=2):
    rng = random.Random(seed)
    # one key holds two thirds of the rows, and many rows share a time
    return [(i, 0 if rng.random() < 0.67 else rng.randrange(1, keys + 1), rng.randrange(-20, span), float(rng.randrange(-50, 50))) for i in range(n)]


@pytest.mark.parametrize("slice_us", [3, 7, 1000, None])
def test_trailing_matches_brute_force(spark, slice_us):
    a, b = sample(1), sample(2)
    left = spark.createDataFrame(a, "id long, k long, t long, v double")
    right = spark.createDataFrame(b, "id long, k long, t long, v double")
    w = 13
    got = trailing(
        left, ["k"], "t",
        [events(right, ["k"], "t", tie=F.col("id"), n=F.lit(1), s="v", seen="t", top="v", final="id")],
        [
            before("b", "sum", "n", w), until("u", "sum", "s", w), closed("c", "sum", "n", w), before("all", "sum", "s", None),
            Feature("last_t", "max", "seen", None, -1), Feature("low", "min", "top", None, 0), Feature("final_id", "last", "final", None, 0),
        ],
        slice_us,
    ).collect()
    assert len(got) == len(a)
    for r in got:
        mine = [x for x in b if x[1] == r.k]
        assert r.b == sum(1 for x in mine if r.t - w <= x[2] < r.t)
        assert r.u == sum(x[3] for x in mine if r.t - w < x[2] <= r.t)
        assert r.c == sum(1 for x in mine if r.t - w <= x[2] <= r.t)
        assert r["all"] == sum(x[3] for x in mine if x[2] < r.t)
        assert r.last_t == max((x[2] for x in mine if x[2] < r.t), default=None)
        assert r.low == min((x[3] for x in mine if x[2] <= r.t), default=None)
        upto = [x for x in mine if x[2] <= r.t]
        assert r.final_id == (max(upto, key=lambda x: (x[2], x[0]))[0] if upto else None)


def test_rows_without_time_keep_null_and_bounded_max_is_refused(spark):
    left = spark.createDataFrame([(1, 0, None), (2, 0, 5)], "id long, k long, t long")
    s = events(left, ["k"], "t", n=F.lit(1))
    got = {r.id: r.n for r in trailing(left, ["k"], "t", [s], [until("n", "sum", "n", 10)], 4).collect()}
    assert got == {1: None, 2: 1}
    with pytest.raises(ValueError):
        trailing(left, ["k"], "t", [s], [Feature("x", "max", "n", -5, -1)])


def test_between_open(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, rng.randrange(100), rng.randrange(100)) for i in range(60)]
    ev = [(i % 2, rng.randrange(100)) for i in range(80)]
    got = between_open(
        spark.createDataFrame(rows, "id long, k long, a long, b long"), ["k"], "a", "b", events(spark.createDataFrame(ev, "k long, t long"), ["k"], "t", n=F.lit(1)), {"x": "n"}, 9
    )
    for r in got.collect():
        assert r.x == sum(1 for k, t in ev if k == r.k and r.a < t < r.b)


@pytest.mark.parametrize("slice_us,chunk", [(4, 7), (1000, 12)])
def test_over_rows_matches_brute_force(spark, slice_us, chunk):
    data = sample(3)
    df = spark.createDataFrame(data, "id long, k long, t long, v double")
    got = over_rows(
        df, ["k"], ["t", "id"], 5,
        {"lag2": lambda r: r.lag("v", 2), "s5": lambda r: F.sum("v").over(r(-5, -1)), "n3": lambda r: F.count("v").over(r(-2, 0))}, slice_us, chunk,
    ).collect()
    assert len(got) == len(data)
    for r in got:
        seq = sorted((x for x in data if x[1] == r.k), key=lambda x: (x[2], x[0]))
        i = [x[0] for x in seq].index(r.id)
        assert r.lag2 == (seq[i - 2][3] if i >= 2 else None)
        assert r.s5 == (sum(x[3] for x in seq[max(0, i - 5) : i]) if i else None)
        assert r.n3 == min(i + 1, 3)


def test_positions_and_running(spark):
    data = sample(5)
    df = spark.createDataFrame(data, "id long, k long, t long, v double").withColumn("s", time_slice(F.col("t"), 6))
    placed = with_position(df, ["k"], ["t", "id"], "s")
    got = running(placed, ["k"], ["t", "id"], "s", [Running("before", "sum", F.col("v"), -1), Running("top", "max", F.col("v"), 0), Running("prev", "last", F.when(F.col("v") > 0, F.col("v")), -1)]).collect()
    for r in got:
        seq = sorted((x for x in data if x[1] == r.k), key=lambda x: (x[2], x[0]))
        i = [x[0] for x in seq].index(r.id)
        assert r.position == i + 1
        assert r.before == sum(x[3] for x in seq[:i])
        assert r.top == max(x[3] for x in seq[: i + 1])
        assert r.prev == next((x[3] for x in reversed(seq[:i]) if x[3] > 0), None)


def test_value_slices_never_fall(spark):
    xs = sorted([0.0, -0.0, 1e-12, 3.0, 3.01, -7.5, 1e12, -1e12, 0.5, 2.0, 4.0, -4.0])
    got = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", value_slice(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got)


def test_run_length_islands_and_age(spark):
    flags = [0, 1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([(i, 0, i * 10, f) for i, f in enumerate(flags)], "id long, k long, t long, f int")
    runs = {r.id: r.run for r in run_length(df, ["k"], ["t", "id"], F.col("f") == 1, "run", slice_us=15).collect()}
    assert [runs[i] for i in range(10)] == [None, 0, 1, 2, 0, 1, 2, 3, 0, 0]
    isl = {r.id: r.island for r in islands(df, ["k"], ["t", "id"], F.col("f"), slice_us=25).collect()}
    assert [isl[i] for i in range(10)] == [1, 2, 2, 3, 4, 4, 4, 5, 5, 6]
    age = {r.id: r.age for r in since_change(df, ["k"], ["t", "id"], F.col("f"), "age", slice_us=25).collect()}
    assert [age[i] for i in range(10)] == [0, 0, 10, 0, 0, 10, 20, 0, 10, 0]


def test_workload_with_resets_across_slices(spark):
    rng = random.Random(8)
    t, rows = 0, []
    for i in range(80):
        t += rng.choice([1, 2, 5, 40])
        rows.append((i, 0, t))
    got = {r.id: r.workload for r in workload(spark.createDataFrame(rows, "id long, k long, t long"), ["k"], ["t", "id"], F.lit(1), 4, 30, slice_us=11).collect()}
    level, last = 0.0, None
    for i, _, at in rows:
        level = 1.0 if last is None or at - last > 30 else max(0.0, level + 1 - (at - last) / 4)
        last = at
        assert abs(got[i] - level) < 1e-9


def test_previous_row_windows_leave_out_later_ties(spark):
    data = sample(9, n=60, span=30, keys=1)
    df = spark.createDataFrame(data, "id long, k long, t long, v double")
    got = previous_row_windows(df, ["k"], ["t", "id"], {"v": "v"}, {"w": 6}, ("mean", "med"), slice_us=10).collect()
    for r in got:
        seq = sorted((x for x in data if x[1] == r.k), key=lambda x: (x[2], x[0]))
        i = [x[0] for x in seq].index(r.id)
        if i == 0:
            assert r.v_mean_w is None
            continue
        frame = [x[3] for x in seq[:i] if x[2] > seq[i - 1][2] - 6]
        assert abs(r.v_mean_w - sum(frame) / len(frame)) < 1e-9
        frame.sort()
        assert r.v_med_w == (frame[(len(frame) - 1) // 2] + frame[len(frame) // 2]) / 2


def test_over_range_matches_brute_force(spark):
    data = sample(10)
    df = spark.createDataFrame(data, "id long, k long, t long, v double")
    got = over_range(df, ["k"], "t", 9, {"top": lambda r: F.max("v").over(r(-9, -1))}, 9).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.top == max((x[3] for x in data if x[1] == r.k and r.t - 9 <= x[2] < r.t), default=None)


def test_changing_the_future_changes_nothing(spark):
    data = sample(11)
    cut = 90
    poisoned = [(i, k, t, 1e6 if t >= cut else v) for i, k, t, v in data]

    def features(rows):
        df = spark.createDataFrame(rows, "id long, k long, t long, v double")
        got = trailing(df, ["k"], "t", [events(df, ["k"], "t", s="v")], [before("s", "sum", "s", 25), before("a", "sum", "s", None)], 10)
        got = over_rows(got, ["k"], ["t", "id"], 4, {"m": lambda r: F.avg("v").over(r(-4, -1))}, 10, 9)
        return {r.id: (r.s, r.a, r.m) for r in got.where(F.col("t") < cut).collect()}

    assert features(data) == features(poisoned)
