"""Queries that fit models; those without an SQL twin are tested against brute force and by their properties."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from eventloom.functions.clock import HOUR
from eventloom.operators import asof as joins
from eventloom.operators import boost, calib, regimes, split, traffic, trees
from eventloom.operators.monotone import isotonic
from eventloom.operators.timeline import Stream
from eventloom.plans.encode_queries import train_val
from eventloom.plans.registry import query
from eventloom.plans.tables import ticks
from eventloom.sources.scratch import written

FEATURES = ["late", "taken", "hour", "month", "slot", "carrier", "kind"]


def data(spark, folder):
    """Training rows, of which the last 15 % in time are held out for early stopping, and the rows to predict.

    Fits read the training rows several times, so they are written once.
    """
    tr, va = train_val(spark, folder)
    tr = split.tail_split(tr.withColumn("base", F.col("late")), "moved_us", "id", 0.15, "held")
    return written(tr, "train"), va.withColumn("base", F.col("late"))


def steps_sql(group: str) -> str:
    """Points of the monotone fit by its definition: the highest over all begins of the lowest over all ends of the mean between them."""
    return f"""SELECT g, x, max(low) AS v FROM (
    SELECT a.g, b.x, min((b.s - a.s + a.t) / (b.w - a.w + a.n)) OVER (PARTITION BY a.g, a.i ORDER BY b.i DESC) AS low
    FROM {group} a JOIN {group} b ON a.g = b.g AND a.i <= b.i)
  GROUP BY g, x"""


def points_sql(group: str) -> str:
    return f"""SELECT {group} AS g, late AS x, sum(y) AS t, count(*) AS n, row_number() OVER (PARTITION BY {group} ORDER BY late) AS i,
    sum(sum(y)) OVER (PARTITION BY {group} ORDER BY late) AS s, sum(count(*)) OVER (PARTITION BY {group} ORDER BY late) AS w FROM tr GROUP BY {group}, late"""


def between_sql(low: str, high: str) -> str:
    return f"""CASE WHEN {low}.v IS NULL THEN {high}.v WHEN {high}.v IS NULL OR {low}.v = {high}.v OR {low}.x = {high}.x THEN {low}.v
    ELSE {low}.v + (va.late - {low}.x) / ({high}.x - {low}.x) * ({high}.v - {low}.v) END"""


@query(
    "m06_isotonic",
    f"""WITH $TV, pe AS ({points_sql("entity")}), fe AS ({steps_sql("pe")}),
pl AS ({points_sql("kind")}), fl AS ({steps_sql("pl")})
SELECT va.id, va.late, round({between_sql("el", "eh")}, 4) AS iso_entity, round({between_sql("ll", "lh")}, 4) AS iso_kind
FROM va ASOF LEFT JOIN fe el ON el.g = va.entity AND va.late >= el.x ASOF LEFT JOIN fe eh ON eh.g = va.entity AND va.late <= eh.x
  ASOF LEFT JOIN fl ll ON ll.g = va.kind AND va.late >= ll.x ASOF LEFT JOIN fl lh ON lh.g = va.kind AND va.late <= lh.x""",
)
def m06(spark, folder):
    """M6: monotone calibration for every entity, and for every kind."""
    tr, va = train_val(spark, folder)
    got = isotonic(tr, va, "late", "y", "iso_entity", ["entity"])
    got = isotonic(tr, got, "late", "y", "iso_kind", ["kind"])
    return got.select("id", "late", F.round("iso_entity", 4).alias("iso_entity"), F.round("iso_kind", 4).alias("iso_kind"))


@query("m06b_isotonic_pooled")
def m06b(spark, folder):
    """M6: one monotone calibration of all rows."""
    tr, va = train_val(spark, folder)
    return isotonic(tr, va, "late", "y", "iso").select("id", "late", F.round("iso", 4).alias("iso"))


@query("m07_residual_boost")
def m07(spark, folder):
    """M7: boosted residual with the chronological tail kept for early stopping."""
    tr, va = data(spark, folder)
    return boost.residual_boost(tr, va, FEATURES, "y", "base", "p", "held").select("id", "y", F.round("p", 4).alias("p"))


@query("m07b_huber_and_quantile_boost")
def m07b(spark, folder):
    """M7: the same with a loss that far values pull little, and the 90 % quantile."""
    tr, va = data(spark, folder)
    got = boost.residual_boost(tr, va, FEATURES, "y", "base", "p_huber", "held", settings=trees.Settings(loss="huber", at=30000.0))
    got = boost.residual_boost(tr, got, FEATURES, "y", "base", "p_90", "held", settings=trees.Settings(loss="quantile", at=0.9))
    return got.select("id", F.round("p_huber", 4).alias("p_huber"), F.round("p_90", 4).alias("p_90"))


@query("m08_entity_experts")
def m08(spark, folder):
    """M8: one expert per entity with enough rows, the pooled one for the rest."""
    tr, va = data(spark, folder)
    return boost.entity_experts(tr, va, "entity", 300, FEATURES, "y", "base", "p", "held").select("id", "entity", F.round("p", 4).alias("p"))


@query("m09_slice_specialist")
def m09(spark, folder):
    """M9: a specialist around the slice mean, overlaid on the general prediction."""
    tr, va = data(spark, folder)
    got = boost.slice_specialist(tr, va, ~F.col("matched"), ["late", "hour", "slot", "kind"], "y", "base", "p", held="held")
    return got.select("id", "matched", F.round("p", 4).alias("p"))


@query("m10_tail_probability")
def m10(spark, folder):
    """Balanced classifier of long outcomes."""
    tr, va = data(spark, folder)
    return boost.tail_probability(tr, va, FEATURES, F.col("y") > 150000, "p_tail", "held").select("id", F.round("p_tail", 6).alias("p_tail"))


@query("m11b_propensity_weights")
def m11b(spark, folder):
    """Logistic propensity of being matched and capped inverse-odds weights."""
    tr, _ = data(spark, folder)
    p = boost.propensity(tr, tr, ["late", "hour", "month", "kind"], F.col("matched"), "p")
    return calib.inverse_odds(p.select("id", "p"), "p", 0.99).select("id", F.round("weight", 6).alias("weight"))


@query("m16_seed_average")
def m16(spark, folder):
    """Mean of the same model under five seeds."""
    tr, va = data(spark, folder)
    return boost.seed_average(tr, va, FEATURES, "y", "base", [1, 2, 3, 4, 5], "p", "held").select("id", F.round("p", 4).alias("p"))


STATES = ["hour_sin", "hour_cos", "n_all", "n_buy", "median"]


def states(spark, folder):
    """Binned states of every entity with the hour on a circle."""
    t = ticks(spark, folder)
    counts = {"n_all": Stream(t, ["entity"], "at_us", {"n_all": F.lit(1)}), "n_buy": Stream(t, ["entity"], "at_us", {"n_buy": F.when(F.col("kind") == "purchase", 1)})}
    got = traffic.binned_state(t, ["entity"], "at_us", 3 * HOUR, 6 * HOUR, counts, "v")
    turn = (F.col("bin") % 8) * F.lit(math.pi / 4)
    return got.withColumn("hour_sin", F.sin(turn)).withColumn("hour_cos", F.cos(turn))


@query("m18_regimes")
def m18(spark, folder):
    """Regimes of binned states, 3 to 6 of them from five starts each, and each bin's previous regime."""
    table = written(states(spark, folder), "states")
    got = regimes.assign(regimes.fit(table, STATES, [3, 4, 5, 6]), table, "regime")
    return joins.previous_bin(got, ["entity"], "bin", "regime", "prev_regime").select("entity", "bin", "regime", "prev_regime")


@query(
    "m18b_silhouette",
    """WITH $TV, x AS (SELECT row_number() OVER () AS i, entity, lane, late / 100000 AS a, y / 100000 AS b FROM va),
d AS (SELECT 'entity' AS "set", p.i, CAST(p.entity AS VARCHAR) AS c, CAST(q.entity AS VARCHAR) AS o, sum((p.a - q.a) ** 2 + (p.b - q.b) ** 2) AS d, count(*) AS n FROM x p, x q GROUP BY p.i, p.entity, q.entity
  UNION ALL SELECT 'lane', p.i, p.lane, q.lane, sum((p.a - q.a) ** 2 + (p.b - q.b) ** 2), count(*) FROM x p, x q GROUP BY p.i, p.lane, q.lane),
s AS (SELECT "set", i, max(CASE WHEN c = o THEN d / nullif(n - 1, 0) END) AS a, min(CASE WHEN c <> o THEN d / n END) AS b FROM d GROUP BY "set", i)
SELECT "set", round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY ALL""",
)
def m18b(spark, folder):
    """Silhouettes of two given groupings of the same rows."""
    _, va = train_val(spark, folder)
    x = va.select("entity", "lane", (F.col("late") / 100000).alias("a"), (F.col("y") / 100000).alias("b"))
    return regimes.silhouettes(x, ["entity", "lane"], ["a", "b"]).select("set", F.round("silhouette", 6).alias("silhouette"))


@query("m23_importance")
def m23(spark, folder):
    """Importances of a boosted model with a class for every feature."""
    tr, _ = data(spark, folder)
    classes = {"late": "clock", "taken": "clock", "hour": "calendar", "month": "calendar"}
    return spark.createDataFrame(boost.importance(tr, FEATURES, "y", "base", classes, "held"), "feature string, kind string, importance double")
