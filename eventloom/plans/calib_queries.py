"""Calibration, blending and small searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import month_of, seconds_between
from eventloom.functions.rows import first_finite, override, tail_weight
from eventloom.operators import calib, history, robust
from eventloom.operators.slices import attach_row
from eventloom.plans.encode_queries import train_val
from eventloom.plans.registry import query
from eventloom.plans.tables import outs

MOMENTS = "count(*) n, avg(y) my, avg(late) m1, avg(hour) m2, covar_pop(y, late) c1, covar_pop(y, hour) c2, var_pop(late) v1, var_pop(hour) v2, covar_pop(late, hour) c12"


def slopes(t: str) -> str:
    """SQL text: centred two-variable prediction from the moments of table ``t``."""
    det = f"({t}.v1 * {t}.v2 - {t}.c12 * {t}.c12)"
    first = f"({t}.c1 * {t}.v2 - {t}.c2 * {t}.c12) / {det} * (late - {t}.m1)"
    second = f"({t}.c2 * {t}.v1 - {t}.c1 * {t}.c12) / {det} * (hour - {t}.m2)"
    return f"{t}.my + {first} + {second}"


@query("m01_ols_two_inputs", f"WITH $TV, s AS (SELECT {MOMENTS} FROM tr) SELECT va.id, round({slopes('s')}, 2) AS p FROM va, s")
def m01(spark, folder):
    """M1: least squares from one aggregate of cross products."""
    tr, va = train_val(spark, folder)
    return calib.ols(tr, va, ["late", "hour"], "y", "p").select("id", F.round("p", 2).alias("p"))


@query(
    "m02_group_ols",
    f"""WITH $TV, g AS (SELECT slot, {MOMENTS} FROM tr GROUP BY slot HAVING count(*) >= 90), s AS (SELECT {MOMENTS} FROM tr)
SELECT va.id, round(CASE WHEN g.n IS NOT NULL THEN {slopes("g")} ELSE {slopes("s")} END, 2) AS p FROM va JOIN s ON true LEFT JOIN g USING (slot)""",
)
def m02(spark, folder):
    """M2: least squares per group, the global fit for small groups."""
    tr, va = train_val(spark, folder)
    return calib.group_ols(tr, va, ["slot"], ["late", "hour"], "y", 90, "p").select("id", F.round("p", 2).alias("p"))


@query(
    "m03_shrunk_group_line",
    """WITH $TV, e AS (SELECT entity, avg(y) m FROM tr GROUP BY entity), g AS (SELECT entity, lane, count(*) n, regr_slope(y, taken) b, regr_intercept(y, taken) a FROM tr WHERE taken IS NOT NULL GROUP BY ALL HAVING count(*) >= 30 AND stddev_pop(taken) > 1e-6)
SELECT va.id, round(CASE WHEN taken IS NOT NULL THEN coalesce(g.n / (g.n + 50.0::DOUBLE), 0) * coalesce(a + b * taken, 0) + (1 - coalesce(g.n / (g.n + 50.0::DOUBLE), 0)) * e.m END, 2) AS p FROM va LEFT JOIN e USING (entity) LEFT JOIN g USING (entity, lane)""",
)
def m03(spark, folder):
    """M3: group lines mixed with the parent prediction by support."""
    tr, va = train_val(spark, folder)
    parent = va.join(tr.groupBy("entity").agg(F.avg("y").alias("m")), ["entity"], "left")
    return calib.shrunk_group_line(tr, parent, ["entity", "lane"], "taken", "y", "m", 30, 50.0, "p").select("id", F.round("p", 2).alias("p"))


@query("m04_group_bias", "WITH $TV, g AS (SELECT entity, avg(y - late) b FROM tr GROUP BY entity) SELECT va.id, round(late + coalesce(b, 0), 4) AS p FROM va LEFT JOIN g USING (entity)")
def m04(spark, folder):
    """M4: additive bias per group."""
    tr, va = train_val(spark, folder)
    return calib.group_bias(tr, va, ["entity"], "y", "late", "p").select("id", F.round("p", 4).alias("p"))


@query("m05_slice_line", "WITH $TV, s AS (SELECT regr_slope(y, late) b, regr_intercept(y, late) a FROM tr WHERE NOT matched) SELECT va.id, round(a + b * late, 3) AS p FROM va, s WHERE NOT matched")
def m05(spark, folder):
    """M5: one-variable line on a slice."""
    tr, va = train_val(spark, folder)
    fit = tr.where("NOT matched").agg(F.regr_slope("y", "late").alias("b"), F.regr_intercept("y", "late").alias("a"))
    return attach_row(va.where("NOT matched"), fit).select("id", F.round(F.col("a") + F.col("b") * F.col("late"), 3).alias("p"))


@query(
    "m12_decomposition",
    """WITH $TV SELECT id, y - 0 AS t, late - y AS g, round(least(greatest((late - y) / greatest(late, 60), 0), 1), 6) AS r, round(least(greatest(y / greatest(late, 60), 0), 1), 6) AS q,
  round(late * least(greatest(y / greatest(late, 60), 0), 1), 4) AS back_q FROM va""",
)
def m12(spark, folder):
    """Decomposition targets and the way back."""
    _, va = train_val(spark, folder)
    t = calib.decomposition(F.col("y"), F.col("late"))
    return va.select(
        "id", t["T"].alias("t"), t["G"].alias("g"), F.round(t["R"], 6).alias("r"), F.round(t["Q"], 6).alias("q"), F.round(calib.recompose("Q", t["Q"], F.col("late")), 4).alias("back_q")
    )


@query(
    "m13_m14_gated_blend",
    """WITH $TV, q AS (SELECT quantile_cont(late, 0.9) h FROM tr), p AS (SELECT va.id, matched, late AS base, coalesce(taken, late) AS rec, 0.25::DOUBLE * late + 0.75::DOUBLE * cents / 2 AS mixed, h FROM va, q)
SELECT id, base + 0.5::DOUBLE * (rec - base) * CASE WHEN base > h OR rec - base > 200 THEN 1 ELSE 0 END AS gated, round(CASE WHEN NOT matched THEN base ELSE mixed END, 4) AS blended FROM p""",
)
def m13(spark, folder):
    """Gated correction, linear blend of experts, override on a slice, first finite value."""
    tr, _ = train_val(spark, folder)
    from eventloom.operators.ranks import quantiles

    o = outs(spark, folder)
    va = o.select("id", "matched", (F.col("cents") / 2).alias("half"), month_of("moved_us").alias("month"), seconds_between("moved_us", "planned_us").cast("double").alias("late"), seconds_between("moved_us", "start_us").cast("double").alias("taken")).where("month IN (1, 7)")
    va = attach_row(va, quantiles(tr, [], "late", {"h": 0.9}))
    gated = calib.gated_blend(F.col("late"), first_finite("taken", "late"), F.col("h"), 200.0, 0.5)
    mixed = calib.blend({"late": 0.25, "half": 0.75})
    return va.select("id", gated.alias("gated"), F.round(override(mixed, ~F.col("matched"), F.col("late")), 4).alias("blended"))


@query(
    "m15_nonnegative_weights",
    """WITH $TV, s AS (SELECT sum(late * late) a, sum(taken * taken) b, sum(late * taken) c, sum(late * y) d, sum(taken * y) e FROM tr WHERE taken IS NOT NULL),
u AS (SELECT *, (d * b - e * c) / (a * b - c * c) w1, (e * a - d * c) / (a * b - c * c) w2 FROM s),
w AS (SELECT CASE WHEN w1 >= 0 AND w2 >= 0 THEN w1 WHEN d * d / a >= e * e / b THEN d / a ELSE 0 END w1, CASE WHEN w1 >= 0 AND w2 >= 0 THEN w2 WHEN d * d / a >= e * e / b THEN 0 ELSE e / b END w2 FROM u)
SELECT va.id, round(w1 / (w1 + w2) * late + w2 / (w1 + w2) * taken, 3) AS p FROM va, w WHERE taken IS NOT NULL""",
)
def m15(spark, folder):
    """Non-negative expert weights from one aggregate of cross products."""
    tr, va = train_val(spark, folder)
    w = calib.nonnegative_weights(tr, ["late", "taken"], "y")
    return va.where("taken IS NOT NULL").select("id", F.round(calib.blend(w), 3).alias("p"))


@query(
    "m17_hard_example_weights",
    """WITH $TV, q AS (SELECT quantile_cont(abs(y - late), 0.9) c FROM tr), s AS (SELECT median(y - late) FILTER (WHERE y - late > 0) t FROM tr)
SELECT id, CASE WHEN abs(y - late) > c THEN (abs(y - late) + 1) * 3 ELSE abs(y - late) + 1 END AS weight, round(least(greatest(1 + greatest(y - late, 0) / t + greatest(y - 1800, 0) / 1800, 1), 10), 6) AS tail FROM tr, q, s""",
)
def m17(spark, folder):
    """Weights that favour hard examples, and tail weights."""
    tr, _ = train_val(spark, folder)
    r = tr.withColumn("r", F.col("y") - F.col("late"))
    got = attach_row(calib.hard_weights(r, "r", 0.9, 3.0), robust.positive_median(r, "r"))
    return got.select("id", "weight", F.round(tail_weight(F.col("r"), F.col("scale"), F.col("y"), 1800.0), 6).alias("tail"))


@query(
    "m11_inverse_odds_weights",
    """WITH $TV, g AS (SELECT carrier, avg(matched::INT) p FROM tr GROUP BY carrier), w AS (SELECT tr.id, (1 - least(greatest(p, 0.001), 0.999)) / least(greatest(p, 0.001), 0.999) w FROM tr JOIN g USING (carrier))
SELECT id, round(least(w, (SELECT quantile_cont(w, 0.95) FROM w)), 6) AS weight FROM w""",
)
def m11(spark, folder):
    """Inverse-odds weights capped at a quantile, here from group rates as the propensity."""
    tr, _ = train_val(spark, folder)
    g = tr.groupBy("carrier").agg(F.avg(F.col("matched").cast("double")).alias("p"))
    return calib.inverse_odds(tr.join(g, ["carrier"]), "p", 0.95).select("id", F.round("weight", 6).alias("weight"))


ALPHAS = [0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0]


@query("m19_parameter_grid", "WITH $TV " + " UNION ALL ".join(f"SELECT 'a{a}' AS candidate, count(taken) AS n, round(sum(pow(y - (late + {a}::DOUBLE * (taken - late)), 2)) / 1e6, 3) AS sse_millions FROM va" for a in ALPHAS))
def m19(spark, folder):
    """A parameter grid scored in one pass."""
    _, va = train_val(spark, folder)
    got = calib.grid_scores(va, "y", {f"a{a}": F.col("late") + F.lit(a) * (F.col("taken") - F.col("late")) for a in ALPHAS})
    return got.select("candidate", "n", F.round(F.col("sse") / 1e6, 3).alias("sse_millions"))


THRESHOLD_PROBS = [i / 10 for i in range(1, 10)]


@query(
    "m20_threshold_rule",
    "WITH $TV, k AS (SELECT *, cents / 3 AS other FROM tr WHERE taken IS NOT NULL), c AS ("
    + " UNION ALL ".join(f"SELECT quantile_cont(hour, {p}) AS t FROM k" for p in THRESHOLD_PROBS)
    + """), d AS (SELECT DISTINCT t FROM c), r AS (SELECT t, 'gt' AS side, sqrt(avg(pow(y - CASE WHEN hour > t THEN taken ELSE late END, 2))) rmse, count(*) FILTER (WHERE hour > t) n_rule FROM k, d GROUP BY t
UNION ALL SELECT t, 'lt', sqrt(avg(pow(y - CASE WHEN hour < t THEN taken ELSE late END, 2))), count(*) FILTER (WHERE hour < t) FROM k, d GROUP BY t),
b AS (SELECT * FROM r ORDER BY rmse, side, t LIMIT 1), a AS (SELECT sqrt(avg(pow(y - taken, 2))) always FROM k)
SELECT CASE WHEN rmse < always - 1 THEN t END AS threshold, CASE WHEN rmse < always - 1 THEN side ELSE 'gt' END AS side, round(CASE WHEN rmse < always - 1 THEN rmse ELSE always END, 4) AS rmse, round(always, 4) AS always, CASE WHEN rmse < always - 1 THEN n_rule END AS n_rule FROM b, a""",
)
def m20(spark, folder):
    """Best one-threshold rule over quantiles in two directions."""
    tr, _ = train_val(spark, folder)
    got = calib.threshold_rule(tr, "hour", "y", "taken", "late", THRESHOLD_PROBS)
    return got.select("threshold", "side", F.round("rmse", 4).alias("rmse"), F.round("always", 4).alias("always"), "n_rule")


@query(
    "m21_vocabulary",
    """WITH $MOVES, v AS (SELECT CAST(slot AS VARCHAR) AS category, count(*) AS n FROM ins GROUP BY 1 HAVING count(*) >= 50), c AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) + 1 AS code FROM v)
SELECT o.id, coalesce(c.code, 1) AS code FROM outs o LEFT JOIN c ON CAST(o.slot AS VARCHAR) = c.category""",
)
def m21(spark, folder):
    """Category codes by falling frequency, unknown for rare ones."""
    from eventloom.plans.tables import ins

    text = F.col("slot").cast("string")
    vocab = history.vocabulary(ins(spark, folder).select(text.alias("slot")), "slot", 50)
    return history.encode(outs(spark, folder).select("id", text.alias("slot")), "slot", vocab, "code").select("id", "code")


@query("m22_scaler", "WITH $TV, s AS (SELECT avg(taken) m, stddev_samp(taken) d FROM tr) SELECT id, round(coalesce(least(greatest((taken - m) / d, -8), 8), 0), 6) AS z FROM va, s")
def m22(spark, folder):
    """Standard scaler fitted on training rows, nulls to 0, values inside plus or minus 8."""
    tr, va = train_val(spark, folder)
    return history.scale(va, ["taken"], history.scaler(tr, ["taken"])).select("id", F.round("z_taken", 6).alias("z"))


@query("d17_univariate_league", "WITH $TV, m AS (SELECT " + ", ".join(f"regr_slope(y, {c}) AS b_{c}, regr_intercept(y, {c}) AS a_{c}" for c in ("late", "taken", "hour")) + " FROM tr) " + " UNION ALL ".join(f"SELECT '{c}' AS predictor, count({c}) AS n, round(sqrt(avg(pow(y - a_{c} - b_{c} * {c}, 2))), 3) AS rmse, round(avg(abs(y - a_{c} - b_{c} * {c})), 3) AS mae FROM va, m" for c in ("late", "taken", "hour")))
def d17(spark, folder):
    """League of one-variable fits."""
    from eventloom.operators import score

    tr, va = train_val(spark, folder)
    got = va
    for c in ("late", "taken", "hour"):
        got = calib.ols(tr, got, [c], "y", f"p_{c}")
    table = score.league(got, "y", {c: F.col(f"p_{c}") for c in ("late", "taken", "hour")})
    return table.select("predictor", "n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))
