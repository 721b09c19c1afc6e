"""Scans of composed functions against a loop over the rows, over slices of all widths, with null keys and times."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators.ranks import ranked
from eventloom.operators.scan import Step, islands, run_length, scan, since_change, workload
from eventloom.operators.slices import Running, running, with_position

KEYS = ["a", "b", None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, rng.choice(KEYS), rng.choice([None, 1]) if i % 9 else 2, rng.randrange(400), rng.choice([None, 0, 0, 1, 1, 1]), rng.randrange(-3, 6)) for i in range(240)]
    return out + [(900, "a", 1, None, 1, 1), (901, None, None, None, 0, 2)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, j int, t long, f int, v int").repartition(5)


def by_key(rows):
    """Rows with a time, by key and in order."""
    out = {}
    for r in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0])):
        out.setdefault((r[1], r[2]), []).append(r)
    return out


@pytest.mark.parametrize("width", [3, 40, 1000])
def test_scan_equals_a_loop(df, rows, width):
    def step(now, before, first):
        return Step(add=now("v") - F.coalesce(before("v"), F.lit(0)), floor=F.when(now("f") == 1, F.lit(-2)), reset=now("v") == 5, start=now("t"))

    want, shifted = {}, {}
    for group in by_key(rows).values():
        x, last = 0, None
        for i, (id_, _, _, t, f, v) in enumerate(group):
            shifted[id_] = x if i else None
            x = t if v == 5 else x + v - (last or 0)
            x = x if v == 5 or f != 1 else max(x, -2)
            want[id_], last = x, v
    want |= {900: None, 901: None}
    shifted |= {900: None, 901: None}
    inputs = {c: F.col(c) for c in "tfv"}
    got = scan(df, ["k", "j"], ["t", "id"], "x", inputs, step, "bigint", False, width)
    assert got.columns == [*df.columns, "x"] and {r.id: r.x for r in got.collect()} == want
    assert {r.id: r.x for r in scan(df, ["k", "j"], ["t", "id"], "x", inputs, step, "bigint", True, width).collect()} == shifted


@pytest.mark.parametrize("width", [3, 40, 1000])
def test_run_lengths_stretches_changes_and_workload(df, rows, width):
    runs, numbers, ages, loads = {}, {}, {}, {}
    for group in by_key(rows).values():
        run = number = load = 0
        since = last = None
        for i, (id_, _, _, t, f, v) in enumerate(group):
            runs[id_] = run if i else None
            run = run + 1 if f == 1 else 0
            if not i or f != last:
                number, since = number + 1, t
            numbers[id_], ages[id_] = number, t - since
            load = max(0.0, load + abs(v) - (t - before) / 4) if i and t - before <= 6 else float(abs(v))
            loads[id_], last, before = load, f, t
    nothing = {900: None, 901: None}
    key, order = ["k", "j"], ["t", "id"]
    assert {r.id: r.n for r in run_length(df, key, order, F.col("f") == 1, "n", slice_us=width).collect()} == runs | nothing
    assert {r.id: r.n for r in islands(df, key, order, F.col("f"), "n", width).collect()} == numbers | nothing
    assert {r.id: r.n for r in since_change(df, key, order, F.col("f"), "n", width).collect()} == ages | nothing
    got = {r.id: r.n for r in workload(df, key, order, F.abs("v"), 4, 6, "n", width).collect()}
    assert got == pytest.approx(loads | nothing, abs=1e-9)


def test_workload_shuffles_its_source_once(df):
    got = workload(df, ["k", "j"], ["t", "id"], F.lit(1), 4, 6, "n", 50)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"(?<!Broadcast)(?<!Reused)Exchange ", plan)) <= 6


def test_null_keys_in_running_and_positions(df, rows):
    cut = df.where("t is not null").withColumn("s", F.floor(F.col("t") / 7))
    sums, places = {}, {}
    for group in by_key(rows).values():
        total = 0
        for i, r in enumerate(group):
            sums[r[0]], total = total, total + r[5]
            places[r[0]] = i + 1
    assert {r.id: r.n for r in running(cut, ["k", "j"], ["t", "id"], "s", [Running("n", "sum", F.col("v"), -1)]).collect()} == sums
    for spread in (False, True):
        got = with_position(cut, ["k", "j"], ["t", "id"], "s", "n", spread_ties=spread, limit=4)
        assert got.columns == [*cut.columns, "n"] and {r.id: r.n for r in got.collect()} == places


def test_positions_of_a_value_that_half_the_rows_have(spark, monkeypatch):
    from eventloom.operators import slices

    monkeypatch.setattr(slices, "ROWS_PER_SLICE", 20)
    rng = random.Random(8)
    rows = [(i, 7.0 if i % 2 else rng.choice([7.0, 7.01, 7.001, rng.uniform(0, 9), -1.0])) for i in range(900)]
    got = ranked(spark.createDataFrame(rows, "id long, v double").repartition(6), [], "v", ["id"])
    want = {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r.position for r in got.collect()} == want
