import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import ranks, split


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    rows = []
    for i in range(300):
        k = "a" if rng.random() < 0.7 else rng.choice("bc")
        v = rng.choice([0.0, 5.0, -5.0, rng.uniform(-1e6, 1e6), rng.uniform(-1, 1)])
        rows.append((i, k, v))
    return rows


def test_group_quantiles(spark, values):
    df = spark.createDataFrame(values, "id long, k string, v double")
    got = ranks.quantiles(df, ["k"], "v", {"m": 0.5, "p": 0.9, "n": (0.25, "nearest")}, count_name="c").collect()
    assert {r.k for r in got} == {"a", "b", "c"}
    for r in got:
        xs = np.sort([v for _, k, v in values if k == r.k])
        assert r.c == len(xs)
        assert np.isclose(r.m, np.quantile(xs, 0.5)) and np.isclose(r.p, np.quantile(xs, 0.9))
        assert r.n == xs[int(np.floor((len(xs) - 1) * 0.25 + 0.5))]


def test_weighted_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (None, 5), (float("nan"), 2)], "v double, w int")
    got = ranks.quantiles(df, [], "v", {"m": 0.5, "top": 1.0}, weight=F.col("w")).first()
    assert (got.m, got.top) == (1.0, 2.0)


def test_bins_positions_and_sums(spark, values):
    df = spark.createDataFrame(values, "id long, k string, v double")
    order = sorted(values, key=lambda x: (x[2], x[0]))
    bins = {r.id: r.bin for r in ranks.even_bins(df, "v", ["id"], 7).collect()}
    for b, part in enumerate(np.array_split([x[0] for x in order], 7), 1):
        assert all(bins[int(i)] == b for i in part)
    sq = df.select((F.col("v") * F.col("v")).alias("sq"))
    want = np.sort([x[2] ** 2 for x in values])[::-1]
    row = ranks.top_sums(sq, "sq", lambda n: {"k7": F.lit(7), "half": F.floor(n / 2)}).first()
    assert np.isclose(row.k7, want[:7].sum()) and np.isclose(row.half, want[:150].sum()) and row.n == 300


def test_average_ranks_and_reference_ranks(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, 9.0)], "id long, v double")
    assert {r.id: r.r for r in ranks.average_ranks(df, [], "v", "r").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: 4.0}
    ref = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (8.0,)], "x double")
    assert {r.id: r.share for r in ranks.rank_in_reference(df, "v", ref, "x", "share").collect()} == {1: 0.25, 2: 0.25, 3: 0.0, 4: 1.0}


def test_tail_split_is_exact(spark):
    df = spark.createDataFrame([(i, (i * 7) % 20) for i in range(41)], "id long, t long")
    got = split.tail_split(df, "t", "id", 0.15).collect()
    order = sorted(((r.t, r.id, r.in_tail) for r in got))
    assert [x[2] for x in order] == [False] * 34 + [True] * 7


def test_positions_with_spread_ties(spark):
    from eventloom.operators.slices import text_slice, with_position

    rng = random.Random(6)
    rows = [(i, rng.randrange(2), float(rng.choice([0, 0, 0, 7, rng.randrange(40)]))) for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "id long, k long, v double").withColumn("s", F.floor(F.col("v") / 8))
    got = with_position(df, ["k"], ["v", "id"], "s", "pos", spread_ties=True, limit=10).collect()
    assert len(got) == len(rows)
    for k in (0, 1):
        want = [x[0] for x in sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0]))]
        assert [r.id for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == want
        assert sorted(r.pos for r in got if r.k == k) == list(range(1, len(want) + 1))
    words = ["", "a", "ab", "abcd", "abc", "b", "Z", "é", "zz"]
    ordered = [(r.w, r.b) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text_slice(F.col("w")).alias("b")).orderBy("w").collect()]
    assert [b for _, b in ordered] == sorted(b for _, b in ordered)
