"""No operator loses rows: null keys are keys of their own, rows without a time come back with null features."""

import math

from pyspark.sql import functions as F

from eventloom.operators import boost, monotone, trees
from eventloom.operators.rowframes import over_rows
from eventloom.operators.timeline import before, events, over_range, trailing


def test_row_frames_keep_null_keys_and_times(spark):
    rows = [(1, "a", 10), (2, "a", 20), (3, None, 10), (4, None, 30), (5, "a", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = {r.id: r.p for r in over_rows(df, ["k"], ["t", "id"], 1, {"p": lambda r: r.lag("id")}).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None, 6: None}
    got = {r.id: r.n for r in over_range(df, ["k"], "t", 100, {"n": lambda r: F.count("*").over(r(-100, 0))}, slice_us=7).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: None, 6: None}


def test_sums_leave_out_what_is_not_finite(spark):
    df = spark.createDataFrame([(1, "a", 1, 1.0), (2, "a", 2, math.nan), (3, "a", 3, math.inf), (4, "a", 4, 2.0), (5, "a", 5, 0.0)], "id long, k string, t long, v double")
    got = trailing(df, ["k"], "t", [events(df, ["k"], "t", v="v")], [before("s", "sum", "v", 2), before("all", "sum", "v", None)])
    assert [(r.s, r["all"]) for r in got.orderBy("id").collect()] == [(0, 0), (1.0, 1.0), (1.0, 1.0), (0, 1.0), (2.0, 3.0)]


def test_isotonic_takes_any_range(spark):
    df = spark.createDataFrame([(i, i / 100 - 0.5, float((i // 10) ** 2)) for i in range(100)] + [(100, None, 1.0)], "id long, x double, y double")
    got = [r.p for r in monotone.isotonic(df, df, "x", "y", "p").orderBy("id").collect()]
    assert len(set(got[:100])) == 10 and got[100] is None and got[:100] == sorted(got[:100])


def test_experts_keep_rows_without_an_entity(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], float(i % 7), float(i)) for i in range(60)], "id long, e string, x double, y double").withColumn("base", F.lit(0.0))
    got = boost.entity_experts(df, df, "e", 5, ["x"], "y", "base", "p", settings=trees.Settings(rounds=2, depth=2, least_rows=2))
    assert got.count() == 60 and got.where("p is null").count() == 0
