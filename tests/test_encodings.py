"""Leakage cases: own rows, validation outcomes, later periods and extreme rows must not be used."""

import math
import random

from pyspark.sql import functions as F

from eventloom.functions.clock import MINUTE
from eventloom.functions.rows import from_log_excess, log_excess
from eventloom.operators import encode, robust
from eventloom.operators.timeline import closed, events, trailing

LEVELS = {"fine": ["entity", "slot", "lane"], "mid": ["entity", "lane"], "all": ["entity"]}
SCHEMA = "id long, entity string, slot string, lane string, month int, matched boolean, y double"


def frame(spark, rows):
    return spark.createDataFrame([(i, "E", "A1", "28", m, ok, y) for i, (m, y, ok) in enumerate(rows)], SCHEMA)


def test_leave_one_month_out_is_the_mean_of_the_others(spark):
    df = frame(spark, [(2, 400.0, True), (3, 800.0, True), (4, 1200.0, True), (5, 1600.0, True)])
    got = encode.leave_period_out(df, "month", LEVELS["fine"], ["entity"], "y", F.col("matched"), 0.0, "x").collect()
    for r in got:
        assert math.isclose(r.enc_x, (4000.0 - r.y) / 3)
        assert r.enc_n_x == 3


def test_validation_outcome_is_never_used(spark):
    train = frame(spark, [(2, 500.0, True), (3, 700.0, True)])
    val = frame(spark, [(7, 50000.0, True)])
    enc = encode.mean_encoding(train, val, LEVELS["fine"], ["entity"], "y", 20.0, "x").first()
    floor = encode.shrunk_floor(train, val, LEVELS, [20.0, 15.0], "y").first()
    assert math.isclose(enc.enc_x, 600.0)
    assert floor.floor < 1000


def test_few_earlier_rows_fall_back_to_other_months(spark):
    df = frame(spark, [(3, 400.0, True), (4, 900.0, True), (5, 1500.0, True)])
    got = {r.month: r.floor for r in encode.time_forward_floor(df, "month", LEVELS, [20.0, 15.0], "y", F.col("matched")).collect()}
    assert abs(got[4] - 400) <= 1
    assert got[5] < 1000


def test_enough_earlier_rows_are_used_alone(spark):
    rng = random.Random(3)
    rows = [(3, float(rng.randrange(300, 500)), True) for _ in range(300)] + [(4, float(rng.randrange(300, 500)), True) for _ in range(300)]
    rows += [(5, 9000.0, True)] * 50 + [(6, 1.0, True)] * 400
    df = frame(spark, rows)
    got = {r.month: r.floor for r in encode.time_forward_floor(df, "month", LEVELS, [20.0, 15.0], "y", F.col("matched")).dropDuplicates(["month"]).collect()}
    early = sorted(y for m, y, _ in rows if m < 5)
    assert math.isclose(got[5], early[int(math.floor((len(early) - 1) * 0.1 + 0.5))])
    assert encode.fold_map({3: 300, 4: 300, 5: 50, 6: 400}, 500) == {3: [4, 5, 6], 4: [3, 5, 6], 5: [3, 4, 6], 6: [3, 4]}


def test_floor_ignores_unmatched_extremes(spark):
    train = frame(spark, [(2, 600.0, True)] * 20 + [(2, 80000.0, False)])
    got = encode.shrunk_floor(train.where("matched"), frame(spark, [(7, 1.0, True)]), LEVELS, [20.0, 15.0], "y").first()
    assert abs(got.floor - 600) <= 1


def test_congestion_window_edges_self_and_lane(spark):
    base = 1_740_823_200_000_000
    dep = [(i, "E", lane, base + m * MINUTE) for i, (m, lane) in enumerate([(0, "28"), (-5, "28"), (-20, "28"), (-5, "32"), (5, "28")])]
    arr = [("E", "28", base - 4 * MINUTE), ("E", "32", base - 3 * MINUTE), ("E", "28", base + 2 * MINUTE)]
    d = spark.createDataFrame(dep, "id long, entity string, lane string, at long")
    a = spark.createDataFrame(arr, "entity string, lane string, at long")
    keys = ["entity", "lane"]
    got = trailing(d, keys, "at", [events(d, keys, "at", n=F.lit(1)), events(a, keys, "at", m=F.lit(1))], [closed("o10", "sum", "n", 10 * MINUTE), closed("o15", "sum", "n", 15 * MINUTE), closed("same", "sum", "m", 10 * MINUTE)], 4 * MINUTE)
    got = trailing(got, ["entity"], "at", [events(a, ["entity"], "at", m=F.lit(1))], [closed("any", "sum", "m", 10 * MINUTE)], 4 * MINUTE, d)
    r = {x.id: x for x in got.collect()}
    assert (r[0].o10 - 1, r[0].o15 - 1, r[0].same, r[0].any - r[0].same) == (1, 1, 1, 1)
    assert r[1].o15 - 1 == 1  # the event exactly 15 minutes earlier counts
    assert r[2].o15 - 1 == 0


def test_log_excess_and_smearing(spark):
    rng = random.Random(7)
    z = [rng.gauss(5, 0.4) for _ in range(5000)]
    df = spark.createDataFrame([(400 + math.exp(x), 5.0, 400.0) for x in z], "y double, zp double, f double")
    s = df.agg(robust.smear_factor(log_excess(F.col("y"), F.col("f")), F.col("zp")).alias("s")).first().s
    assert s > 1
    true = sum(400 + math.exp(x) for x in z) / len(z)
    row = df.select(from_log_excess(F.col("zp"), F.col("f")).alias("naive"), from_log_excess(F.col("zp"), F.col("f"), s).alias("smeared")).first()
    assert abs(row.smeared - true) < abs(row.naive - true)
    low = spark.createDataFrame([(100.0, 400.0)], "y double, f double").select(log_excess(F.col("y"), F.col("f")).alias("z")).first()
    assert low.z == 0.0
