"""Frame statistics and mixes against loops over the rows, over slices of all widths, with ties, nulls and nan."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators.rolling import _spread, frame_statistics, mix, ranks_in_ranges
from eventloom.operators.rowframes import previous_row_windows

STATS = ["mean", "std", "med", "p90", "near75"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    value = lambda: rng.choice([None, math.nan, float(rng.randrange(50)), rng.uniform(-1, 1), 7.0])
    out = [(i, rng.choice(["a", None, "b"]), rng.randrange(300), value(), float(rng.randrange(900)), rng.choice(["x", "y", "z", None, "x"])) for i in range(260)]
    return out + [(900, "a", None, 3.0, 1.0, "x"), (901, None, None, 3.0, 1.0, None)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, t long, v double, w double, r string").repartition(5)


def stat_of(x, stat):
    x = sorted(v for v in x if v is not None and not math.isnan(v))
    if not x or (stat == "std" and len(x) < 2):
        return None
    at = (len(x) - 1) * {"med": 0.5, "p90": 0.9, "near75": 0.75}.get(stat, 0)
    if stat == "near75":
        return x[math.floor(at + 0.5)]
    if stat in ("mean", "std"):
        return statistics.fmean(x) if stat == "mean" else statistics.stdev(x)
    return x[math.floor(at)] + (x[math.ceil(at)] - x[math.floor(at)]) * (at - math.floor(at))


def frames_of(rows, column, width, peers):
    out = {}
    for r in rows:
        inside = [x for x in rows if x[1] == r[1] and None not in (x[2], r[2]) and r[2] - width < x[2] <= r[2] and (peers or (x[2], x[0]) <= (r[2], r[0]))]
        out[r[0]] = [x[column] for x in inside] if r[2] is not None else []
    return out


@pytest.mark.parametrize("peers", [False, True])
@pytest.mark.parametrize("slice_us", [1, 60, None])
def test_frame_statistics(df, rows, peers, slice_us):
    frames = {f"{c}_{s}_{w}": (c, w, s) for c in "vw" for w in (25, 90) for s in STATS}
    got = frame_statistics(df, ["k"], ["t", "id"], frames, peers, slice_us)
    assert got.columns == [*df.columns, *frames]
    found = {r.id: r for r in got.collect()}
    assert len(found) == len(rows)
    for c, at in (("v", 3), ("w", 4)):
        for w in (25, 90):
            for id_, inside in frames_of(rows, at, w, peers).items():
                for s in STATS:
                    want = stat_of(inside, s)
                    assert found[id_][f"{c}_{s}_{w}"] == (None if want is None else pytest.approx(want, abs=1e-12)), (id_, c, s, w)


def test_windows_that_end_at_the_previous_row(df, rows):
    got = {r.id: r for r in previous_row_windows(df, ["k"], ["t", "id"], {"v": "v"}, {"s": 40}, slice_us=50).collect()}
    own = frames_of(rows, 3, 40, False)
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == k and r[2] is not None), key=lambda r: (r[2], r[0]))
        for before, r in zip([None, *mine], mine):
            for s in ("mean", "med", "p90", "std"):
                want = stat_of(own[before[0]], s) if before else None
                assert got[r[0]][f"v_{s}_s"] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_ranks_in_ranges():
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 9, 400), rng.normal(size=257), np.full(30, 4)):
        begin = rng.integers(0, len(values), 300)
        end = np.minimum(begin + 1 + rng.integers(0, len(values), 300), len(values))
        rank = (rng.random(300) * (end - begin)).astype(int)
        want = [np.sort(values[i:j])[k] for i, j, k in zip(begin, end, rank)]
        assert ranks_in_ranges(values, begin, end, rank).tolist() == want


def test_spread_of_a_constant_and_of_large_numbers():
    begin, end = np.array([0, 0, 5]), np.array([2, 10, 10])
    assert _spread(np.full(10, 1e15 / 3), begin, end).tolist() == [0, 0, 0]
    x = 1e9 + np.arange(10.0)
    assert _spread(x, begin, end) == pytest.approx([np.std(x[i:j], ddof=1) for i, j in zip(begin, end)])


def test_frames_of_a_hundred_thousand_rows(spark):
    n = 200_000
    df = spark.range(n).select("id", F.lit("a").alias("k"), F.col("id").alias("t"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"))
    got = frame_statistics(df, ["k"], ["t", "id"], {"m": ("v", 100_000, "med"), "p": ("v", 100_000, "near90")})
    x = np.arange(n) * 7919 % 100_003
    for r in got.where("id % 40000 = 39999").collect():
        inside = np.sort(x[max(0, r.id - 99_999) : r.id + 1])
        assert r.m == np.median(inside) and r.p == inside[math.floor((len(inside) - 1) * 0.9 + 0.5)]


@pytest.mark.parametrize("slice_us", [1, 37, None])
@pytest.mark.parametrize("width", [30, 5000])
def test_mix(df, rows, slice_us, width):
    found = {r.id: r for r in mix(df, ["k"], "t", "r", width, slice_us).collect()}
    assert len(found) == len(rows)
    for r in rows:
        inside = [x[5] for x in rows if x[1] == r[1] and None not in (x[2], r[2], x[5]) and r[2] - width <= x[2] < r[2]]
        got = found[r[0]]
        if not inside:
            assert (got.n or 0, got.top or 0, got.dominant, got.entropy) == (0, 0, None, None)
            continue
        counts = {c: inside.count(c) for c in sorted(set(inside))}
        top = max(counts.values())
        want = -sum(c / len(inside) * math.log(c / len(inside)) for c in counts.values())
        assert (got.n, got.top, got.dominant) == (len(inside), top, next(c for c in counts if counts[c] == top))
        assert got.entropy == pytest.approx(want, abs=1e-12)
