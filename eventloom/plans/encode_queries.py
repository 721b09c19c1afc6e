"""Group statistics, encodings, robust scales and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import hour_of, month_of, seconds_between
from eventloom.operators import encode, ranks, robust
from eventloom.operators.rowframes import over_rows
from eventloom.plans.registry import query
from eventloom.plans.tables import CTES, outs

VALIDATION_MONTHS = (1, 7)

CTES["TV"] = (
    CTES["MOVES"]
    + """,
o AS (SELECT *, CAST(month(make_timestamp(moved_us)) AS INT) AS month, CAST(hour(make_timestamp(moved_us)) AS INT) AS hour,
  CAST((moved_us - start_us) // 1000000 AS DOUBLE) AS taken, CAST((moved_us - planned_us) // 1000000 AS DOUBLE) AS late FROM outs),
tr AS (SELECT * FROM o WHERE month NOT IN (1, 7)), va AS (SELECT * FROM o WHERE month IN (1, 7))"""
)


def near(q: float) -> str:
    return f"list_sort(list(y))[CAST(floor((count(y) - 1) * {q} + 0.5) AS INT) + 1]"


def train_val(spark, folder):
    o = outs(spark, folder)
    o = o.select(
        "id", "entity", "lane", "slot", "carrier", "kind", "matched", "moved_us", "start_us", "y",
        month_of("moved_us").alias("month"), hour_of("moved_us").alias("hour"),
        seconds_between("moved_us", "start_us").cast("double").alias("taken"),
        seconds_between("moved_us", "planned_us").cast("double").alias("late"),
    )
    inside = F.col("month").isin(*VALIDATION_MONTHS)
    return o.where(~inside), o.where(inside)


LEVELS = {"sl": ["entity", "slot", "lane"], "st": ["entity", "slot"], "ln": ["entity", "lane"], "en": ["entity"]}
STATS = f"count(y) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 3) AS std, median(y) AS med, {near(.25)} AS p25, {near(.75)} AS p75, {near(.9)} AS p90"


@query(
    "a01_group_statistics",
    f"""WITH $TV
SELECT 'sl' AS level, entity, slot, lane, {STATS} FROM tr GROUP BY entity, slot, lane
UNION ALL SELECT 'st', entity, slot, NULL, {STATS} FROM tr GROUP BY entity, slot
UNION ALL SELECT 'ln', entity, NULL, lane, {STATS} FROM tr GROUP BY entity, lane
UNION ALL SELECT 'en', entity, NULL, NULL, {STATS} FROM tr GROUP BY entity""",
)
def a01(spark, folder):
    """A1: n, mean, std, median and nearest percentiles at four key levels."""
    tr, _ = train_val(spark, folder)
    g = encode.group_stats_levels(tr, LEVELS, "y")
    return g.select("level", "entity", "slot", "lane", "n", F.round("mean", 6).alias("mean"), F.round("std", 3).alias("std"), "med", "p25", "p75", "p90")


@query(
    "a02_supported_lookup",
    f"""WITH $TV, sl AS (SELECT entity, slot, lane, count(y) n, avg(y) mean, median(y) med, {near(.25)} p25, {near(.75)} p75 FROM tr GROUP BY ALL),
st AS (SELECT entity, slot, count(y) n, avg(y) mean, median(y) med FROM tr GROUP BY ALL), ln AS (SELECT entity, lane, count(y) n, avg(y) mean, median(y) med FROM tr GROUP BY ALL),
en AS (SELECT entity, avg(y) mean, median(y) med FROM tr GROUP BY ALL)
SELECT va.id, round(CASE WHEN sl.n >= 5 THEN sl.mean WHEN st.n >= 5 THEN st.mean WHEN ln.n >= 5 THEN ln.mean ELSE en.mean END, 6) AS geo_mean,
  CASE WHEN sl.n >= 5 THEN sl.med WHEN st.n >= 5 THEN st.med WHEN ln.n >= 5 THEN ln.med ELSE en.med END AS geo_med,
  CASE WHEN sl.n >= 5 THEN sl.n ELSE 0 END AS n_used, round(sl.mean - st.mean, 6) AS minus_slot, round(sl.mean - en.mean, 6) AS minus_entity, sl.p75 - sl.p25 AS iqr
FROM va LEFT JOIN sl USING (entity, slot, lane) LEFT JOIN st USING (entity, slot) LEFT JOIN ln USING (entity, lane) LEFT JOIN en USING (entity)""",
)
def a02(spark, folder):
    """A2: hierarchical lookup with minimum support, differences between levels, inter-quartile range."""
    tr, va = train_val(spark, folder)
    got = encode.attach_levels(va, {n: (k, encode.group_stats(tr, k, "y")) for n, k in LEVELS.items()})
    names = list(LEVELS)
    return got.select(
        "id", F.round(encode.first_supported(names, "mean", 5), 6).alias("geo_mean"), encode.first_supported(names, "med", 5).alias("geo_med"),
        F.when(F.col("sl_n") >= 5, F.col("sl_n")).otherwise(F.lit(0)).alias("n_used"),
        F.round(F.col("sl_mean") - F.col("st_mean"), 6).alias("minus_slot"), F.round(F.col("sl_mean") - F.col("en_mean"), 6).alias("minus_entity"),
        (F.col("sl_p75") - F.col("sl_p25")).alias("iqr"),
    )


@query(
    "a03_median_hierarchy",
    """WITH $TV SELECT va.id, coalesce(a.m, b.m, c.m) AS med FROM va LEFT JOIN (SELECT entity, slot, lane, median(y) m FROM tr GROUP BY ALL) a USING (entity, slot, lane)
LEFT JOIN (SELECT entity, lane, median(y) m FROM tr GROUP BY ALL) b USING (entity, lane) LEFT JOIN (SELECT entity, median(y) m FROM tr GROUP BY ALL) c USING (entity)""",
)
def a03(spark, folder):
    """A3: medians by falling key detail, without a support test."""
    tr, va = train_val(spark, folder)
    levels = {"sl": LEVELS["sl"], "ln": LEVELS["ln"], "en": LEVELS["en"]}
    got = encode.attach_levels(va, encode.quantile_levels(tr, levels, "y", 0.5, "linear"))
    return got.select("id", F.coalesce("sl_q", "ln_q", "en_q").alias("med"))


FLOOR_KS = [20.0, 15.0]
FLOOR_LEVELS = {"sl": LEVELS["sl"], "ln": LEVELS["ln"], "en": LEVELS["en"]}


def floor_sql(hist: str, target: str, keep: str = "") -> str:
    """SQL text of the shrunk low quantile; ``keep`` adds the fold column to every key."""
    k, using = (f"{keep}, " if keep else ""), (f"{keep}, " if keep else "")
    lane = "CASE WHEN b.n > 0 THEN (b.n * b.q + 15.0::DOUBLE * c.q) / (b.n + 15.0::DOUBLE) ELSE c.q END"
    return f"""SELECT t.id, round(greatest(CASE WHEN a.n > 0 THEN (a.n * a.q + 20.0::DOUBLE * ({lane})) / (a.n + 20.0::DOUBLE) ELSE {lane} END, 1), 6) AS floor,
  CAST(coalesce(a.n, 0) AS DOUBLE) AS floor_n
FROM {target} t LEFT JOIN (SELECT {k}entity, slot, lane, count(y) n, {near(.1)} q FROM {hist} GROUP BY ALL) a USING ({using}entity, slot, lane)
LEFT JOIN (SELECT {k}entity, lane, count(y) n, {near(.1)} q FROM {hist} GROUP BY ALL) b USING ({using}entity, lane)
LEFT JOIN (SELECT {k}entity, {near(.1)} q FROM {hist} GROUP BY ALL) c USING ({using}entity)"""


@query("a04_shrunk_floor", f"WITH $TV, h AS (SELECT * FROM tr WHERE matched) {floor_sql('h', 'va')}")
def a04(spark, folder):
    """A4: hierarchical shrunk p10 floor from matched training rows, applied to validation rows."""
    tr, va = train_val(spark, folder)
    got = encode.shrunk_floor(tr.where("matched"), va, FLOOR_LEVELS, FLOOR_KS, "y")
    return got.select("id", F.round("floor", 6).alias("floor"), "floor_n")


@query(
    "a05_time_forward_floor",
    f"""WITH $TV, c AS (SELECT month, count(*) AS n FROM tr GROUP BY month),
f AS (SELECT a.month AS target, coalesce(sum(b.n) FILTER (WHERE b.month < a.month), 0) >= 500 AS forward FROM c a, c b GROUP BY a.month),
h AS (SELECT f.target AS month, tr.* EXCLUDE (month) FROM tr JOIN f ON CASE WHEN f.forward THEN tr.month < f.target ELSE tr.month <> f.target END WHERE tr.matched)
{floor_sql('h', 'tr', 'month')}""",
)
def a05(spark, folder):
    """A5: floors from earlier months only, or from all other months while there are few earlier rows."""
    tr, _ = train_val(spark, folder)
    got = encode.time_forward_floor(tr, "month", FLOOR_LEVELS, FLOOR_KS, "y", F.col("matched"))
    return got.select("id", F.round("floor", 6).alias("floor"), "floor_n")


@query(
    "a06_mean_encoding",
    """WITH $TV, h AS (SELECT * FROM tr WHERE matched), p AS (SELECT entity, avg(y) m FROM h GROUP BY entity), s AS (SELECT entity, slot, lane, count(y) n, avg(y) m FROM h GROUP BY ALL), c AS (SELECT entity, carrier, count(y) n, avg(y) m FROM h GROUP BY ALL)
SELECT va.id, round(CASE WHEN s.n > 0 THEN (s.n * s.m + 20.0::DOUBLE * p.m) / (s.n + 20.0::DOUBLE) ELSE p.m END, 6) AS enc_slot_lane, CAST(coalesce(s.n, 0) AS DOUBLE) AS enc_n_slot_lane,
  round(CASE WHEN c.n > 0 THEN (c.n * c.m + 25.0::DOUBLE * p.m) / (c.n + 25.0::DOUBLE) ELSE p.m END, 6) AS enc_carrier, CAST(coalesce(c.n, 0) AS DOUBLE) AS enc_n_carrier
FROM va LEFT JOIN p USING (entity) LEFT JOIN s USING (entity, slot, lane) LEFT JOIN c USING (entity, carrier)""",
)
def a06(spark, folder):
    """Shrunk mean encodings fitted on training rows, applied to validation rows."""
    tr, va = train_val(spark, folder)
    hist = tr.where("matched")
    got = encode.mean_encoding(hist, va, LEVELS["sl"], ["entity"], "y", 20.0, "slot_lane")
    got = encode.mean_encoding(hist, got, ["entity", "carrier"], ["entity"], "y", 25.0, "carrier")
    return got.select("id", *[F.round(c, 6).alias(c) for c in ("enc_slot_lane", "enc_carrier")], "enc_n_slot_lane", "enc_n_carrier")


@query(
    "a07_leave_month_out_encoding",
    """WITH $TV, h AS (SELECT * FROM tr WHERE matched), p AS (SELECT m.month, h.entity, avg(h.y) v FROM (SELECT DISTINCT month FROM tr) m JOIN h ON h.month <> m.month GROUP BY ALL),
s AS (SELECT m.month, h.entity, h.slot, h.lane, count(h.y) n, avg(h.y) v FROM (SELECT DISTINCT month FROM tr) m JOIN h ON h.month <> m.month GROUP BY ALL)
SELECT tr.id, round(CASE WHEN s.n > 0 THEN (s.n * s.v + 20.0::DOUBLE * p.v) / (s.n + 20.0::DOUBLE) ELSE p.v END, 6) AS enc, CAST(coalesce(s.n, 0) AS DOUBLE) AS enc_n
FROM tr LEFT JOIN p USING (month, entity) LEFT JOIN s USING (month, entity, slot, lane)""",
)
def a07(spark, folder):
    """Encodings of training rows from all other months, by subtraction of the own month."""
    tr, _ = train_val(spark, folder)
    got = encode.leave_period_out(tr, "month", LEVELS["sl"], ["entity"], "y", F.col("matched"), 20.0, "x")
    return got.select("id", F.round("enc_x", 6).alias("enc"), F.col("enc_n_x").alias("enc_n"))


@query(
    "a07b_leave_fold_out_encoding",
    """WITH $TV, j AS (SELECT *, (row_number() OVER (ORDER BY moved_us, id) - 1) % 5 AS fold FROM va), h AS (SELECT * FROM j WHERE matched),
p AS (SELECT m.fold, h.entity, avg(h.y) v FROM (SELECT DISTINCT fold FROM j) m JOIN h ON h.fold <> m.fold GROUP BY ALL),
s AS (SELECT m.fold, h.entity, h.carrier, count(h.y) n, avg(h.y) v FROM (SELECT DISTINCT fold FROM j) m JOIN h ON h.fold <> m.fold GROUP BY ALL)
SELECT j.id, round(CASE WHEN s.n > 0 THEN (s.n * s.v + 20.0::DOUBLE * p.v) / (s.n + 20.0::DOUBLE) ELSE p.v END, 6) AS enc, CAST(coalesce(s.n, 0) AS DOUBLE) AS enc_n
FROM j LEFT JOIN p USING (fold, entity) LEFT JOIN s USING (fold, entity, carrier)""",
)
def a07b(spark, folder):
    """Where there is no other month, five folds by position in time take its place."""
    from eventloom.operators.split import position_folds

    _, va = train_val(spark, folder)
    folded = position_folds(va, "moved_us", "id", 5, "fold")
    got = encode.leave_period_out(folded, "fold", ["entity", "carrier"], ["entity"], "y", F.col("matched"), 20.0, "x")
    return got.select("id", F.round("enc_x", 6).alias("enc"), F.col("enc_n_x").alias("enc_n"))


@query(
    "a08_service_profile",
    """WITH $TV, l0 AS (SELECT entity, carrier, lane, median(y) m, avg(y) a, count(y) n FROM tr GROUP BY ALL), l1 AS (SELECT entity, lane, median(y) m, count(y) n FROM tr GROUP BY ALL),
l2 AS (SELECT entity, median(y) m FROM tr GROUP BY ALL), lh AS (SELECT entity, carrier, hour, median(y) m, count(y) n FROM tr GROUP BY ALL),
j AS (SELECT va.id, coalesce(l0.n, 0) n0, l0.m m0, l0.a a0, l1.m m1, coalesce(lh.n, 0) nh, lh.m mh, CASE WHEN coalesce(l1.n, 0) >= 5 THEN l1.m ELSE l2.m END pm FROM va
  LEFT JOIN l0 USING (entity, carrier, lane) LEFT JOIN l1 USING (entity, lane) LEFT JOIN l2 USING (entity) LEFT JOIN lh USING (entity, carrier, hour)),
k AS (SELECT *, CASE WHEN n0 > 0 THEN (n0 * m0 + 20.0::DOUBLE * pm) / (n0 + 20.0::DOUBLE) ELSE pm END svc FROM j)
SELECT id, round(svc, 6) AS svc_med, round(CASE WHEN nh > 0 THEN (nh * mh + 20.0::DOUBLE * svc) / (nh + 20.0::DOUBLE) ELSE svc END, 6) AS svc_hour, n0 AS svc_n, round(coalesce(a0, m1), 6) AS svc_mean FROM k""",
)
def a08(spark, folder):
    """Service profile: shrunk medians over three key levels and by hour."""
    tr, va = train_val(spark, folder)
    med = lambda keys: (keys, ranks.quantiles(tr, keys, "y", {"q": 0.5}, count_name="n"))
    keys = ["entity", "carrier", "lane"]
    got = encode.attach_levels(
        va, {"s0": med(keys), "s1": med(["entity", "lane"]), "s2": med(["entity"]), "sh": med(["entity", "carrier", "hour"])}
    ).join(tr.groupBy(*keys).agg(F.avg("y").alias("s0_mean")), keys, "left")
    n0, nh = F.coalesce("s0_n", F.lit(0)), F.coalesce("sh_n", F.lit(0))
    parent = F.when(F.coalesce("s1_n", F.lit(0)) >= 5, F.col("s1_q")).otherwise(F.col("s2_q"))
    svc = encode.shrink(n0, F.col("s0_q"), parent, 20.0)
    return got.select(
        "id", F.round(svc, 6).alias("svc_med"), F.round(encode.shrink(nh, F.col("sh_q"), svc, 20.0), 6).alias("svc_hour"), n0.alias("svc_n"),
        F.round(F.coalesce("s0_mean", "s1_q"), 6).alias("svc_mean"),
    )


@query(
    "a09_physical_prior",
    """WITH $TV, a AS (SELECT entity, lane, kind, median(y) m, count(y) n FROM tr GROUP BY ALL), b AS (SELECT entity, lane, median(y) m FROM tr GROUP BY ALL), c AS (SELECT entity, median(y) m FROM tr GROUP BY ALL)
SELECT va.id, round(CASE WHEN a.n > 0 THEN (a.n * a.m + 30.0::DOUBLE * coalesce(b.m, c.m)) / (a.n + 30.0::DOUBLE) ELSE coalesce(b.m, c.m) END, 6) AS prior
FROM va LEFT JOIN a USING (entity, lane, kind) LEFT JOIN b USING (entity, lane) LEFT JOIN c USING (entity)""",
)
def a09(spark, folder):
    """Shrunk median prior over (lane, class), lane, entity."""
    tr, va = train_val(spark, folder)
    levels = {"a": ["entity", "lane", "kind"], "b": ["entity", "lane"], "c": ["entity"]}
    got = encode.attach_levels(va, encode.quantile_levels(tr, levels, "y", 0.5, "linear"))
    parent = F.coalesce("b_q", "c_q")
    return got.select("id", F.round(encode.shrink(F.coalesce("a_n", F.lit(0)), F.col("a_q"), parent, 30.0), 6).alias("prior"))


PRIOR_KEYS = {"by_carrier": ["carrier"], "by_carrier_entity": ["carrier", "entity"], "by_carrier_lane": ["carrier", "entity", "lane"], "by_slot": ["slot", "entity"]}


@query(
    "a10_residual_priors",
    "WITH $TV, r AS (SELECT *, y - late AS resid FROM tr) SELECT va.id, "
    + ", ".join(f"round(coalesce(t_{n}.c, 0), 6) AS {n}" for n in PRIOR_KEYS)
    + " FROM va "
    + " ".join(f"LEFT JOIN (SELECT {', '.join(k)}, count(*) / (count(*) + 20.0::DOUBLE) * avg(resid) AS c FROM r GROUP BY ALL) t_{n} USING ({', '.join(k)})" for n, k in PRIOR_KEYS.items()),
)
def a10(spark, folder):
    """A10: empirical-Bayes residual priors over several key sets."""
    tr, va = train_val(spark, folder)
    fitted = tr.withColumn("resid", F.col("y") - F.col("late"))
    got = va
    for name, keys in PRIOR_KEYS.items():
        got = encode.residual_prior(fitted, got, keys, "resid", 20.0, name)
    return got.select("id", *[F.round(n, 6).alias(n) for n in PRIOR_KEYS])


@query(
    "a11_event_rate_mix",
    """WITH $TV, b AS (SELECT avg(CASE WHEN y > 86400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) p0 FROM tr), g AS (SELECT carrier, count(*) n, avg(CASE WHEN y > 86400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) p FROM tr GROUP BY carrier),
e AS (SELECT entity, avg(y) m FROM tr GROUP BY entity)
SELECT va.id, round((g.n * g.p + 10.0::DOUBLE * b.p0) / (g.n + 10.0::DOUBLE), 6) AS rate, round((1 - (g.n * g.p + 10.0::DOUBLE * b.p0) / (g.n + 10.0::DOUBLE)) * e.m + (g.n * g.p + 10.0::DOUBLE * b.p0) / (g.n + 10.0::DOUBLE) * va.late, 4) AS mixed
FROM va JOIN b ON true LEFT JOIN g USING (carrier) LEFT JOIN e USING (entity)""",
)
def a11(spark, folder):
    """Smoothed event rate by key and the two-source mix it weights."""
    tr, va = train_val(spark, folder)
    long = F.col("y") > 86400
    p0 = tr.agg(F.avg(F.when(long, 1.0).otherwise(0.0))).scalar()
    got = encode.event_rate(tr, va, ["carrier"], long, 10.0, p0, "rate").join(tr.groupBy("entity").agg(F.avg("y").alias("m")), ["entity"], "left")
    return got.select("id", F.round("rate", 6).alias("rate"), F.round(encode.mix(F.col("m"), F.col("late"), F.col("rate")), 4).alias("mixed"))


@query(
    "a12_analogues",
    """WITH $TV, r AS (SELECT *, y - late AS resid FROM tr), l1 AS (SELECT entity, lane, slot, count(*) n, avg(resid) m, stddev_pop(resid) s FROM r GROUP BY ALL HAVING count(*) >= 5),
l2 AS (SELECT entity, slot, count(*) n, avg(resid) m, stddev_pop(resid) s FROM r GROUP BY ALL HAVING count(*) >= 5), l3 AS (SELECT entity, lane, count(*) n, avg(resid) m, stddev_pop(resid) s FROM r GROUP BY ALL HAVING count(*) >= 5)
SELECT va.id, round(coalesce(l1.m, l2.m, l3.m, 0), 6) AS analogue, round(coalesce(CASE WHEN l1.n IS NOT NULL THEN l1.n / (l1.n + 2.0::DOUBLE) / (1 + l1.s / 600.0::DOUBLE) WHEN l2.n IS NOT NULL THEN l2.n / (l2.n + 2.0::DOUBLE) / (1 + l2.s / 600.0::DOUBLE)
  ELSE l3.n / (l3.n + 2.0::DOUBLE) / (1 + l3.s / 600.0::DOUBLE) END, 0), 6) AS confidence
FROM va LEFT JOIN l1 USING (entity, lane, slot) LEFT JOIN l2 USING (entity, slot) LEFT JOIN l3 USING (entity, lane)""",
)
def a12(spark, folder):
    """Analogue lookup over three key levels with minimum support and a confidence."""
    tr, va = train_val(spark, folder)
    got = encode.analogues(tr.withColumn("resid", F.col("y") - F.col("late")), va, [["entity", "lane", "slot"], ["entity", "slot"], ["entity", "lane"]], "resid")
    return got.select("id", F.round("analogue", 6).alias("analogue"), F.round("confidence", 6).alias("confidence"))


@query(
    "a13_slice_statistic",
    """WITH $TV, u AS (SELECT * FROM tr WHERE NOT matched), g AS (SELECT entity, carrier, avg(y) m, median(y) d FROM u GROUP BY ALL), w AS (SELECT avg(y) m, median(y) d FROM u)
SELECT va.id, round(coalesce(g.m, w.m), 6) AS slice_mean, coalesce(g.d, w.d) AS slice_median FROM va JOIN w ON true LEFT JOIN g USING (entity, carrier)""",
)
def a13(spark, folder):
    """Mean and median of a slice by key, the whole slice's value for unseen keys."""
    tr, va = train_val(spark, folder)
    u = tr.where("NOT matched")
    keys = ["entity", "carrier"]
    g = u.groupBy(*keys).agg(F.avg("y").alias("m")).join(ranks.median_table(u, keys, "y", "d"), keys)
    mean, med = u.agg(F.avg("y")).scalar(), ranks.median_table(u, [], "y", "d").scalar()
    got = va.join(g, keys, "left")
    return got.select("id", F.round(F.coalesce("m", mean), 6).alias("slice_mean"), F.coalesce("d", med).alias("slice_median"))


@query(
    "a14_climatology",
    """WITH $TV, g AS (SELECT entity, hour, avg(taken) m, count(*) n FROM tr GROUP BY ALL)
SELECT va.id, round(g.m, 6) AS clim_mean, g.n AS clim_n, round(va.taken - g.m, 6) AS clim_anomaly, round(va.taken / greatest(g.m, 1), 6) AS vs_hour FROM va LEFT JOIN g USING (entity, hour)""",
)
def a14(spark, folder):
    """Climatology by (entity, hour), anomaly and ratio against it."""
    tr, va = train_val(spark, folder)
    got = encode.climatology(tr, va, ["entity", "hour"], "taken", "clim")
    return got.select(
        "id", F.round("clim_mean", 6).alias("clim_mean"), "clim_n", F.round("clim_anomaly", 6).alias("clim_anomaly"),
        F.round(F.col("taken") / F.greatest(F.col("clim_mean"), F.lit(1.0)), 6).alias("vs_hour"),
    )


@query(
    "a15_delay_shock",
    """WITH $TV, l AS (SELECT *, lag(taken) OVER (PARTITION BY entity ORDER BY moved_us, id) AS p1, lag(taken) OVER (PARTITION BY entity, lane ORDER BY moved_us, id) AS lp1 FROM o),
ltr AS (SELECT * FROM l WHERE month NOT IN (1, 7) AND matched), h AS (SELECT entity, hour, avg(taken) m FROM ltr GROUP BY ALL), ln AS (SELECT entity, lane, avg(taken) m FROM ltr GROUP BY ALL), e AS (SELECT entity, avg(taken) m FROM ltr GROUP BY ALL)
SELECT l.id, round(l.p1 - coalesce(h.m, e.m), 6) AS shock, round(l.lp1 - coalesce(ln.m, e.m), 6) AS lane_shock FROM l LEFT JOIN h USING (entity, hour) LEFT JOIN ln USING (entity, lane) LEFT JOIN e USING (entity) WHERE l.month IN (1, 7)""",
)
def a15(spark, folder):
    """Shock of the previous delay against climatology, with a lane variant and entity fallback."""
    tr, va = train_val(spark, folder)
    both = tr.unionByName(va)
    lagged = over_rows(both, ["entity"], ["moved_us", "id"], 1, {"p1": lambda r: r.lag("taken")})
    lagged = over_rows(lagged, ["entity", "lane"], ["moved_us", "id"], 1, {"lp1": lambda r: r.lag("taken")}, base=both)
    fit = tr.where("matched")
    mean = lambda keys, n: fit.groupBy(*keys).agg(F.avg("taken").alias(n))
    got = lagged.where(F.col("month").isin(*VALIDATION_MONTHS))
    got = got.join(mean(["entity", "hour"], "h"), ["entity", "hour"], "left").join(mean(["entity", "lane"], "l"), ["entity", "lane"], "left").join(mean(["entity"], "e"), ["entity"], "left")
    return got.select("id", F.round(F.col("p1") - F.coalesce("h", "e"), 6).alias("shock"), F.round(F.col("lp1") - F.coalesce("l", "e"), 6).alias("lane_shock"))


@query(
    "a16_additive_corrections",
    """WITH $TV, r AS (SELECT *, y - late AS resid FROM tr), b AS (SELECT entity, quantile_cont(resid, 0.05) lo, quantile_cont(resid, 0.95) hi FROM r GROUP BY entity)
SELECT entity, round(avg(resid), 6) AS mean, median(resid) AS median, round(avg(least(greatest(resid, lo), hi)), 4) AS winsor, count(*) AS n FROM r JOIN b USING (entity) GROUP BY entity HAVING count(*) >= 20""",
)
def a16(spark, folder):
    """Mean, median and winsorised corrections by group with a minimum size."""
    tr, _ = train_val(spark, folder)
    r = tr.select("entity", (F.col("y") - F.col("late")).alias("resid"))
    w = robust.winsorised_mean(r, ["entity"], "resid").where("n >= 20")
    got = w.join(r.groupBy("entity").agg(F.avg("resid").alias("mean")), ["entity"]).join(ranks.median_table(r, ["entity"], "resid", "median"), ["entity"])
    return got.select("entity", F.round("mean", 6).alias("mean"), "median", F.round("winsor", 4).alias("winsor"), "n")


@query(
    "a16b_additive_applied",
    """WITH $TV, r AS (SELECT *, y - late AS resid FROM tr), g AS (SELECT slot, median(resid) c FROM r GROUP BY slot HAVING count(*) >= 90), w AS (SELECT median(resid) c FROM r)
SELECT va.id, va.late + coalesce(g.c, w.c) AS corrected FROM va JOIN w ON true LEFT JOIN g USING (slot)""",
)
def a16b(spark, folder):
    """The correction applied, with the global one for small groups."""
    tr, va = train_val(spark, folder)
    got = robust.additive_correction(tr.withColumn("resid", F.col("y") - F.col("late")), va, ["slot"], "resid", "median", 90, "c")
    return got.select("id", (F.col("late") + F.col("c")).alias("corrected"))


@query(
    "a17_a18_robust_scales",
    """WITH $TV, r AS (SELECT y - late AS resid FROM tr WHERE matched), m AS (SELECT median(resid) md, count(*) n FROM r), d AS (SELECT median(abs(resid - md)) mad FROM r, m), p AS (SELECT median(resid) FILTER (WHERE resid > 0) s FROM r)
SELECT n, md AS median, mad, round(1.4826 * mad, 6) AS sigma, round(greatest(1.345 * 1.4826 * mad, 1), 6) AS delta, s AS scale FROM m, d, p""",
)
def a17(spark, folder):
    """Median, MAD, robust bound, and the median positive residual."""
    tr, _ = train_val(spark, folder)
    r = tr.where("matched").select((F.col("y") - F.col("late")).alias("resid"))
    row = robust.attach_row(robust.robust_scale(r, "resid"), robust.positive_median(r, "resid"))
    return row.select("n", "median", "mad", F.round("sigma", 6).alias("sigma"), F.round("delta", 6).alias("delta"), "scale")


@query(
    "a19_smearing",
    """WITH $TV, f AS (SELECT entity, quantile_cont(y, 0.1) q FROM tr GROUP BY entity), z AS (SELECT tr.entity, ln(greatest(y - q, 1)) z FROM tr JOIN f USING (entity)), p AS (SELECT entity, avg(z) zp FROM z GROUP BY entity)
SELECT z.entity, CASE WHEN count(*) < 10 THEN 1 ELSE round(least(greatest(avg(exp(least(greatest(z - zp, -2.5), 2.5))), 1), 3), 6) END AS smear FROM z JOIN p USING (entity) GROUP BY z.entity""",
)
def a19(spark, folder):
    """Log excess over a floor and the smearing factor of its inverse."""
    from eventloom.functions.rows import log_excess

    tr, _ = train_val(spark, folder)
    f = ranks.quantiles(tr, ["entity"], "y", {"q": 0.1})
    z = tr.join(f, ["entity"]).select("entity", log_excess(F.col("y"), F.col("q")).alias("z"))
    z = z.join(z.groupBy("entity").agg(F.avg("z").alias("zp")), ["entity"])
    return z.groupBy("entity").agg(F.round(robust.smear_factor(F.col("z"), F.col("zp")), 6).alias("smear"))


@query(
    "a20_correlations",
    """WITH $TV SELECT a, b, round(r, 6) AS r FROM (
SELECT 'taken' a, 'y' b, corr(taken, y) r FROM o UNION ALL SELECT 'taken', 'cents', corr(taken, cents) FROM o
UNION ALL SELECT 'late', 'y', corr(late, y) FROM o UNION ALL SELECT 'late', 'cents', corr(late, cents) FROM o)""",
)
def a20(spark, folder):
    """Guarded correlations of several columns in one aggregate."""
    o = outs(spark, folder).select(
        "y", "cents", seconds_between("moved_us", "start_us").cast("double").alias("taken"), seconds_between("moved_us", "planned_us").cast("double").alias("late")
    )
    got = robust.correlation_table(o, ["taken", "late"], ["y", "cents"])
    return got.select("a", "b", F.round("r", 6).alias("r"))


@query(
    "a21_spearman",
    """WITH $TV, r AS (SELECT rank() OVER (ORDER BY late) + (count(*) OVER (PARTITION BY late) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS rb FROM o)
SELECT round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM r""",
)
def a21(spark, folder):
    """Rank correlation with average ranks."""
    tr, va = train_val(spark, folder)
    return robust.spearman(tr.unionByName(va), "late", "y").select(F.round("spearman", 6).alias("spearman"), "n")


@query(
    "a22_variance_share",
    "WITH $TV, t AS (SELECT avg(y) m, var_pop(y) * count(*) v FROM o) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS factor, count(*) AS groups, round(sum(c * pow(g - m, 2)) / max(v), 6) AS eta2 FROM (SELECT count(*) c, avg(y) g FROM o GROUP BY {', '.join(k)}), t"
        for n, k in LEVELS.items()
    ),
)
def a22(spark, folder):
    """Share of the outcome's variance between the groups of each factor."""
    tr, va = train_val(spark, folder)
    return robust.variance_share(tr.unionByName(va), LEVELS, "y").select("factor", "groups", F.round("eta2", 6).alias("eta2"))


@query(
    "a23_stability_index",
    "WITH $TV, e AS (SELECT [" + ", ".join(f"quantile_cont(y, {i / 10})" for i in range(1, 10)) + """] AS e FROM tr),
ca AS (SELECT len(list_filter(e, lambda q: q <= y)) AS bin, count(*) AS na FROM tr, e GROUP BY 1), cb AS (SELECT len(list_filter(e, lambda q: q <= y)) AS bin, count(*) AS nb FROM va, e GROUP BY 1),
j AS (SELECT coalesce(na, 0) na, coalesce(nb, 0) nb, sum(na) OVER () ta, sum(nb) OVER () tb FROM ca FULL JOIN cb USING (bin))
SELECT round(sum((nb / tb + 1e-6 - na / ta - 1e-6) * ln((nb / tb + 1e-6) / (na / ta + 1e-6))), 6) AS psi FROM j""",
)
def a23(spark, folder):
    """Population stability index over equal-frequency bins of the reference."""
    tr, va = train_val(spark, folder)
    return robust.stability_index(tr, va, "y").select(F.round("psi", 6).alias("psi"))
