"""Trailing traffic, disruption, occupancy, service and configuration features."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import DAY, SECOND, seconds_between
from eventloom.functions.rows import ratio
from eventloom.operators import traffic
from eventloom.operators.rowframes import over_rows
from eventloom.operators.slices import slice_width, time_slice, with_position
from eventloom.operators.timeline import Feature, before, closed, events, trailing, until
from eventloom.plans.registry import query
from eventloom.plans.tables import ins, moves, outs


def pair_counts(left: str, right: str, keys: list[str], cols: str, extra: str = "", at: str = "moved_us", r_at: str = "moved_us", reach: str = "60 * $DAY") -> str:
    """SQL text: brute-force pairs of one stream with another, aggregated per left row."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"SELECT a.id, {cols} FROM {left} a LEFT JOIN {right} b ON {on} AND b.{r_at} BETWEEN a.{at} - {reach} AND a.{at} {extra} GROUP BY a.id"


def n_before(w: str, b: str = "b.moved_us") -> str:
    return f"count({b}) FILTER (WHERE {b} >= a.moved_us - {w} AND {b} < a.moved_us)"


def n_until(w: str, b: str = "b.moved_us") -> str:
    return f"count({b}) FILTER (WHERE {b} > a.moved_us - {w} AND {b} <= a.moved_us)"


@query(
    "w02_traffic_ratios",
    f"""WITH $MOVES,
d AS ({pair_counts("outs", "outs", ["entity"], f"{n_until('5 * $DAY')} - 1 AS d5, {n_until('15 * $DAY')} - 1 AS d15, {n_until('60 * $DAY')} - 1 AS d60")}),
i AS ({pair_counts("outs", "ins", ["entity"], f"{n_until('15 * $DAY')} AS a15, {n_until('60 * $DAY')} AS a60")})
SELECT id, d5, d15, d60, a15, a60, d15 + a15 AS mov_15, d60 + a60 AS mov_60, round(d15 / greatest(d60, 1), 6) AS ratio_15_60,
  round(d5 - d15 / 3.0::DOUBLE, 6) AS accel, round(a15 / (d15 + 1), 6) AS in_out_ratio, d15 - d5 AS d_5_15
FROM d JOIN i USING (id)""",
)
def w02(spark, folder):
    """Same-stream and cross-stream trailing counts with ratios and accelerations."""
    m = moves(spark, folder).select("id", "entity", "moved_us", "phase")
    o, i = m.where("phase = 'OUT'").drop("phase"), m.where("phase = 'IN'").drop("phase")
    got = trailing(
        o, ["entity"], "moved_us",
        [events(o, ["entity"], "moved_us", d=F.lit(1)), events(i, ["entity"], "moved_us", a=F.lit(1))],
        [until(f"d{w}", "sum", "d", w * DAY) for w in (5, 15, 60)] + [until(f"a{w}", "sum", "a", w * DAY) for w in (15, 60)],
    )
    d5, d15, d60, a15, a60 = F.col("d5") - 1, F.col("d15") - 1, F.col("d60") - 1, F.col("a15"), F.col("a60")
    return got.select(
        "id", d5.alias("d5"), d15.alias("d15"), d60.alias("d60"), a15.alias("a15"), a60.alias("a60"),
        (d15 + a15).alias("mov_15"), (d60 + a60).alias("mov_60"),
        F.round(d15 / F.greatest(d60, F.lit(1)), 6).alias("ratio_15_60"),
        F.round(d5 - d15 / F.lit(3.0), 6).alias("accel"),
        F.round(a15 / (d15 + 1), 6).alias("in_out_ratio"),
        (d15 - d5).alias("d_5_15"),
    )


@query(
    "w03_surface_counts",
    f"""WITH $MOVES,
d AS ({pair_counts("outs", "outs", ["entity"], ", ".join(f"{n_before(f'{w} * $DAY')} AS out_{w}d" for w in (5, 30)) + ", (max(a.moved_us) - max(b.moved_us) FILTER (WHERE b.moved_us < a.moved_us)) / 1e6 AS out_since", reach="100000 * $DAY")}),
i AS ({pair_counts("outs", "ins", ["entity"], ", ".join(f"{n_before(f'{w} * $DAY')} AS in_{w}d" for w in (5, 30)) + ", (max(a.moved_us) - max(b.moved_us) FILTER (WHERE b.moved_us < a.moved_us)) / 1e6 AS in_since", reach="100000 * $DAY")}),
ld AS ({pair_counts("outs", "outs", ["entity", "lane"], f"{n_before('30 * $DAY')} AS lane_out_30d")}),
li AS ({pair_counts("outs", "ins", ["entity", "lane"], f"{n_before('30 * $DAY')} AS lane_in_30d")})
SELECT id, out_5d, out_30d, round(out_since, 6) AS out_since, in_5d, in_30d, round(in_since, 6) AS in_since, lane_out_30d, lane_in_30d,
  out_5d + in_5d AS pressure, round(out_5d - out_30d / 6.0::DOUBLE, 6) AS burst
FROM d JOIN i USING (id) JOIN ld USING (id) JOIN li USING (id)""",
)
def w03(spark, folder):
    """Counts strictly before t per stream, by entity and by lane, with time since the last event."""
    m = moves(spark, folder).select("id", "entity", "lane", "moved_us", "phase")
    o, i = m.where("phase = 'OUT'").drop("phase"), m.where("phase = 'IN'").drop("phase")
    got = traffic.surface_counts(o, ["entity"], "moved_us", {"out": o, "in": i}, {"5d": 5 * DAY, "30d": 30 * DAY})
    got = traffic.surface_counts(got, ["entity", "lane"], "moved_us", {"lane_out": o, "lane_in": i}, {"30d": 30 * DAY}, since=False, base=o)
    return got.select(
        "id", "out_5d", "out_30d", F.round("out_since", 6).alias("out_since"), "in_5d", "in_30d", F.round("in_since", 6).alias("in_since"),
        "lane_out_30d", "lane_in_30d", (F.col("out_5d") + F.col("in_5d")).alias("pressure"),
        F.round(F.col("out_5d") - F.col("out_30d") / F.lit(6.0), 6).alias("burst"),
    )


@query(
    "w07_lane_memory",
    """WITH $MOVES, x AS (
  SELECT *, row_number() OVER o - 1 AS pos, lag(moved_us) OVER o AS prev FROM outs WINDOW o AS (PARTITION BY entity, lane ORDER BY moved_us, id))
SELECT id, pos - (SELECT count(*) FROM outs b WHERE b.entity = x.entity AND b.lane = x.lane AND b.moved_us < x.moved_us - 30 * $DAY) AS n_30d,
  pos - (SELECT count(*) FROM outs b WHERE b.entity = x.entity AND b.lane = x.lane AND b.moved_us < x.moved_us - 5 * $DAY) AS n_5d,
  (moved_us - prev) // $SECOND AS gap
FROM x""",
)
def w07(spark, folder):
    """Lane memory; rows before the current one in sort order count even when their time is equal."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us")
    keys = ["entity", "lane"]
    placed = with_position(o.withColumn("_s", time_slice(F.col("moved_us"), slice_width([(o, "moved_us")]))), keys, ["moved_us", "id"], "_s", "pos")
    s = events(o, keys, "moved_us", n=F.lit(1))
    got = trailing(placed, keys, "moved_us", [s], [Feature("old_30", "sum", "n", None, -30 * DAY - 1), Feature("old_5", "sum", "n", None, -5 * DAY - 1)], base=o)
    got = over_rows(got, keys, ["moved_us", "id"], 1, {"gap": lambda r: seconds_between("moved_us", r.lag("moved_us"))}, base=o)
    return got.select("id", (F.col("pos") - 1 - F.col("old_30")).alias("n_30d"), (F.col("pos") - 1 - F.col("old_5")).alias("n_5d"), "gap")


@query(
    "w13_pressure",
    f"""WITH $MOVES,
d AS ({pair_counts("outs", "outs", ["entity"], ", ".join(f"{n_before(f'{w} * $DAY')} AS out_{w}d" for w in (2, 10)))}),
i AS ({pair_counts("outs", "ins", ["entity"], f"{n_before('10 * $DAY')} AS in_10d, count(*) FILTER (WHERE b.moved_us < a.moved_us AND b.moved_us >= a.moved_us - 10 * $DAY AND b.moved_us - b.planned_us > $DAY) AS in_late_10d")}),
g AS (SELECT id, (moved_us - lag(moved_us) OVER o) / 1e6 AS gap FROM outs WINDOW o AS (PARTITION BY entity ORDER BY moved_us, id))
SELECT id, out_2d, out_10d, in_10d, in_late_10d, CASE WHEN gap > 0 THEN round(3600 / gap, 6) ELSE 0 END AS inverse_gap
FROM d JOIN i USING (id) JOIN g USING (id)""",
)
def w13(spark, folder):
    """Pressure counts, late arrivals of the same entity, inverse gap."""
    m = moves(spark, folder).select("id", "entity", "moved_us", "planned_us", "phase")
    o, i = m.where("phase = 'OUT'"), m.where("phase = 'IN'")
    late = F.when(F.col("moved_us") - F.col("planned_us") > DAY, 1)
    got = trailing(
        o.select("id", "entity", "moved_us"), ["entity"], "moved_us",
        [events(o, ["entity"], "moved_us", n=F.lit(1)), events(i, ["entity"], "moved_us", a=F.lit(1), late=late)],
        [before("out_2d", "sum", "n", 2 * DAY), before("out_10d", "sum", "n", 10 * DAY), before("in_10d", "sum", "a", 10 * DAY), before("in_late_10d", "sum", "late", 10 * DAY)],
    )
    got = over_rows(got, ["entity"], ["moved_us", "id"], 1, {"gap": lambda r: (F.col("moved_us") - r.lag("moved_us")) / F.lit(float(SECOND))}, base=o)
    return got.select("id", "out_2d", "out_10d", "in_10d", "in_late_10d", F.when(F.col("gap") > 0, F.round(F.lit(3600) / F.col("gap"), 6)).otherwise(F.lit(0.0)).alias("inverse_gap"))


@query(
    "w14_push_delay_state",
    f"""WITH $MOVES, x AS (SELECT *, CAST((start_us - filed_us) // $SECOND AS DOUBLE) AS delay FROM outs)
SELECT a.id, {", ".join(f'''count(b.delay) FILTER (WHERE b.start_us > a.moved_us - {w} * $DAY) AS push_n_{w}d,
  round(avg(b.delay) FILTER (WHERE b.start_us > a.moved_us - {w} * $DAY), 6) AS push_mean_{w}d,
  round(avg(CASE WHEN b.delay > 1200 THEN 1.0 ELSE 0.0 END) FILTER (WHERE b.start_us > a.moved_us - {w} * $DAY), 6) AS push_over20_{w}d''' for w in (5, 30))}
FROM x a LEFT JOIN x b ON a.entity = b.entity AND a.id <> b.id AND b.delay IS NOT NULL AND b.start_us > a.moved_us - 30 * $DAY AND b.start_us <= a.moved_us
GROUP BY a.id""",
)
def w14(spark, folder):
    """State of recent starts of others at each completion; the own start lies at another clock and is taken out."""
    o = outs(spark, folder).select("id", "entity", "moved_us", "start_us", seconds_between("start_us", "filed_us").cast("double").alias("delay"))
    got = traffic.delay_state(
        o, ["entity"], "moved_us", o, "start_us", "delay", {"5d": 5 * DAY, "30d": 30 * DAY}, {"20": 1200.0}, "push", "start_us", "delay"
    )
    names = [f"push_{s}_{w}" for w in ("5d", "30d") for s in ("n", "mean", "over20")]
    return got.select("id", *[F.col(c) if "_n_" in c else F.round(c, 6).alias(c) for c in names])


@query(
    "w15_rolling_quantiles_asof",
    """WITH $MOVES, p AS (SELECT id, entity, start_us, CAST((start_us - filed_us) // $SECOND AS DOUBLE) AS v FROM outs WHERE start_us IS NOT NULL),
w AS (SELECT a.entity, a.start_us, list_sort(list(b.v)) AS l FROM (SELECT DISTINCT entity, start_us FROM p) a JOIN p b
  ON a.entity = b.entity AND b.start_us > a.start_us - 30 * $DAY AND b.start_us <= a.start_us GROUP BY a.entity, a.start_us),
q AS (SELECT entity, start_us, list_aggregate(l, 'median') AS med, l[CAST(floor((len(l) - 1) * 0.75 + 0.5) AS INT) + 1] AS p75,
  l[CAST(floor((len(l) - 1) * 0.9 + 0.5) AS INT) + 1] AS p90 FROM w)
SELECT o.id, q.med AS push_med, q.p75 AS push_p75, q.p90 AS push_p90
FROM outs o ASOF LEFT JOIN q ON o.entity = q.entity AND o.moved_us >= q.start_us""",
)
def w15(spark, folder):
    """Median and nearest p75 / p90 of recent starts, read at the last start at or before t."""
    o = outs(spark, folder).select("id", "entity", "moved_us", "start_us", seconds_between("start_us", "filed_us").alias("delay"))
    return traffic.window_quantiles_asof(o, o, ["entity"], "moved_us", "start_us", "delay", 30 * DAY, "push").select("id", "push_med", "push_p75", "push_p90")


@query(
    "w16_arrival_delay_state",
    f"""WITH $MOVES
SELECT a.id, count(b.id) AS in_n_10d, round(avg(CAST((b.moved_us - b.planned_us) // $SECOND AS DOUBLE)), 6) AS in_mean_10d
FROM outs a LEFT JOIN ins b ON a.entity = b.entity AND b.moved_us > a.moved_us - 10 * $DAY AND b.moved_us <= a.moved_us
GROUP BY a.id""",
)
def w16(spark, folder):
    """Count and mean lateness of the other stream in (t - w, t]."""
    o = outs(spark, folder).select("id", "entity", "moved_us")
    i = ins(spark, folder).select("entity", "moved_us", seconds_between("moved_us", "planned_us").cast("double").alias("late"))
    got = traffic.delay_state(o, ["entity"], "moved_us", i, "moved_us", "late", {"10d": 10 * DAY}, {}, "in")
    return got.select("id", "in_n_10d", F.round("in_mean_10d", 6).alias("in_mean_10d"))


@query(
    "w17_neighbour_mix",
    """WITH $MOVES, x AS (SELECT *, CAST((moved_us - start_us) // $SECOND AS DOUBLE) AS taken, CAST((start_us - filed_us) // $SECOND AS DOUBLE) AS push FROM outs)
SELECT a.id, count(b.id) AS n, round(avg(b.taken), 6) AS taken_mean, round(avg(b.push), 6) AS push_mean,
  round(sum(b.taken) / nullif(sum(b.taken) + sum(abs(b.push)), 0), 6) AS taken_share
FROM x a LEFT JOIN x b ON a.entity = b.entity AND a.id <> b.id AND b.start_us IS NOT NULL AND b.moved_us > a.moved_us - 30 * $DAY AND b.moved_us <= a.moved_us
GROUP BY a.id""",
)
def w17(spark, folder):
    """Mean duration and delay of neighbours in (t - w, t], the row itself taken out."""
    o = outs(spark, folder).select(
        "id", "entity", "moved_us", seconds_between("moved_us", "start_us").cast("double").alias("taken"), seconds_between("start_us", "filed_us").cast("double").alias("push")
    )
    s = events(o, ["entity"], "moved_us", n=F.when(F.col("taken").isNotNull(), 1), t="taken", p="push", ap=F.abs("push"))
    got = trailing(o, ["entity"], "moved_us", [s], [until(f"_{m}", "sum", m, 30 * DAY) for m in ("n", "t", "p", "ap")])
    own = F.col("taken").isNotNull()
    less = lambda c, x: F.col(c) - F.when(own, x).otherwise(F.lit(0))
    n, t, p, ap = less("_n", F.lit(1)), less("_t", F.col("taken")), less("_p", F.col("push")), less("_ap", F.abs("push"))
    return got.select(
        "id", n.alias("n"), F.when(n > 0, F.round(t / n, 6)).alias("taken_mean"), F.when(n > 0, F.round(p / n, 6)).alias("push_mean"),
        F.when(n > 0, F.round(ratio(t, t + ap), 6)).alias("taken_share"),
    )


@query(
    "w18_congestion",
    """WITH $MOVES, q AS (SELECT *, coalesce(start_us, moved_us) AS at FROM outs),
s AS (SELECT a.id, count(b.id) AS same_out FROM q a LEFT JOIN outs b ON a.entity = b.entity AND a.lane = b.lane AND a.id <> b.id AND b.start_us BETWEEN a.at - 15 * $DAY AND a.at GROUP BY a.id),
i AS (SELECT a.id, count(b.id) FILTER (WHERE b.lane = a.lane) AS same_in, count(b.id) FILTER (WHERE b.lane <> a.lane) AS other_in
  FROM q a LEFT JOIN ins b ON a.entity = b.entity AND b.moved_us BETWEEN a.at - 15 * $DAY AND a.at GROUP BY a.id)
SELECT id, same_out, same_in, other_in FROM s JOIN i USING (id)""",
)
def w18(spark, folder):
    """Starts on the same lane, arrivals on the same and on other lanes, in [q - w, q] at a coalesced clock."""
    m = moves(spark, folder).select("id", "entity", "lane", "moved_us", "start_us", "phase")
    o = m.where("phase = 'OUT'").withColumn("at", F.coalesce("start_us", "moved_us"))
    i = m.where("phase = 'IN'")
    keys = ["entity", "lane"]
    got = trailing(
        o, keys, "at", [events(o, keys, "start_us", s=F.lit(1)), events(i, keys, "moved_us", a=F.lit(1))],
        [closed("same_out", "sum", "s", 15 * DAY), closed("same_in", "sum", "a", 15 * DAY)],
    )
    got = trailing(got, ["entity"], "at", [events(i, ["entity"], "moved_us", a=F.lit(1))], [closed("all_in", "sum", "a", 15 * DAY)], base=o)
    return got.select(
        "id", (F.col("same_out") - F.col("start_us").isNotNull().cast("long")).alias("same_out"), "same_in", (F.col("all_in") - F.col("same_in")).alias("other_in")
    )


@query(
    "w19_occupancy_queue",
    f"""WITH $MOVES, m AS (SELECT * FROM outs WHERE start_us IS NOT NULL),
e AS (SELECT a.id, a.entity, a.moved_us, greatest((SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.start_us < a.moved_us)
    - (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.moved_us < a.moved_us) - 1, 0) AS queue,
  greatest((SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.start_us < a.moved_us)
    - (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.moved_us < a.moved_us) - 1, 0) AS lane_queue,
  (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.start_us > a.moved_us - 5 * $DAY AND b.start_us <= a.moved_us) AS started_5d
  FROM m a)
SELECT a.id, queue, lane_queue, started_5d, queue - lag(queue, 5) OVER o AS growth5, queue - lag(queue, 10) OVER o AS growth10,
  round(queue / greatest(started_5d, 1), 6) AS queue_per_start
FROM outs a LEFT JOIN e ON a.id = e.id WINDOW o AS (PARTITION BY a.entity ORDER BY a.moved_us, a.id)""",
)
def w19(spark, folder):
    """Occupancy at completion by entity and lane, recent starts and the ratio, growth against 5 and 10 of all rows back."""
    rows = outs(spark, folder).select("id", "entity", "lane", "moved_us", "start_us")
    o = rows.where("start_us IS NOT NULL")
    begun = events(o, ["entity"], "start_us", b=F.lit(1))
    done = events(o, ["entity"], "moved_us", d=F.lit(1))
    got = trailing(
        o, ["entity"], "moved_us", [begun, done],
        [Feature("_b", "sum", "b"), Feature("_d", "sum", "d"), until("started_5d", "sum", "b", 5 * DAY)],
    ).withColumn("queue", F.greatest(F.col("_b") - F.col("_d") - 1, F.lit(0)))
    got = traffic.occupancy(got, ["entity", "lane"], "moved_us", o, "start_us", "moved_us", "lane_queue", own=1, base=o)
    got = rows.join(got.select("id", "queue", "lane_queue", "started_5d"), "id", "left")
    got = over_rows(
        got, ["entity"], ["moved_us", "id"], 10, {f"growth{k}": (lambda r, k=k: F.col("queue") - r.lag("queue", k)) for k in (5, 10)}, base=rows
    )
    per_start = F.round(F.col("queue") / F.greatest(F.col("started_5d"), F.lit(1)), 6)
    return got.select("id", "queue", "lane_queue", "started_5d", "growth5", "growth10", per_start.alias("queue_per_start"))


@query(
    "w20_occupancy_at_start",
    """WITH $MOVES, m AS (SELECT * FROM outs WHERE start_us IS NOT NULL),
e AS (SELECT a.id, a.kind, a.start_us,
  (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.start_us <= a.start_us) - (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.moved_us <= a.start_us) AS active,
  (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.start_us <= a.start_us) - (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.moved_us <= a.start_us) AS active_lane,
  (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.kind = a.kind AND b.start_us <= a.start_us)
   - (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.kind = a.kind AND b.moved_us <= a.start_us) AS active_kind,
  (SELECT count(*) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.moved_us > a.start_us - 30 * $DAY AND b.moved_us <= a.start_us) AS served_30d,
  (SELECT max_by(b.kind, (b.moved_us, b.id)) FROM m b WHERE b.entity = a.entity AND b.lane = a.lane AND b.moved_us < a.start_us) AS prev_kind
  FROM m a)
SELECT a.id, active, active_lane, active - active_lane AS active_other, active_kind, served_30d, prev_kind, round(active_lane / CASE WHEN served_30d < 0.5 THEN 0.5 ELSE served_30d END, 6) AS queue_service
FROM outs a LEFT JOIN e ON a.id = e.id""",
)
def w20(spark, folder):
    """Occupancy at the start clock by entity, lane and class, service counts, class of the previous completion; null without that clock."""
    rows = outs(spark, folder).select("id", "entity", "lane", "kind", "moved_us", "start_us")
    o = rows.where("start_us IS NOT NULL")
    keys = ["entity", "lane"]
    got = traffic.occupancy(o, ["entity"], "start_us", o, "start_us", "moved_us", "active", through_now=True)
    begun = events(o, keys, "start_us", b=F.lit(1))
    done = events(o, keys, "moved_us", tie=F.col("id"), d=F.lit(1), last="kind")
    got = trailing(
        got, keys, "start_us", [begun, done],
        [Feature("_b", "sum", "b", None, 0), Feature("_d", "sum", "d", None, 0), until("served_30d", "sum", "d", 30 * DAY), Feature("prev_kind", "last", "last")],
        base=o,
    )
    got = traffic.occupancy(got, [*keys, "kind"], "start_us", o, "start_us", "moved_us", "active_kind", through_now=True, base=o)
    lane = F.col("_b") - F.col("_d")
    got = rows.select("id").join(got.drop("entity", "lane", "kind", "moved_us", "start_us"), "id", "left")
    return got.select(
        "id", "active", lane.alias("active_lane"), (F.col("active") - lane).alias("active_other"), "active_kind", "served_30d", "prev_kind",
        F.round(lane / F.when(F.col("served_30d") < 0.5, F.lit(0.5)).otherwise(F.col("served_30d").cast("double")), 6).alias("queue_service"),
    )


@query(
    "w21_congestion_bank",
    """WITH $MOVES, m AS (SELECT *, CAST((moved_us - start_us) // $SECOND AS DOUBLE) AS p FROM outs WHERE start_us IS NOT NULL),
e AS (SELECT a.id, count(b.id) AS n_prev, avg(b.p) AS p_mean FROM m a LEFT JOIN m b ON a.entity = b.entity AND b.start_us >= a.start_us - 30 * $DAY AND b.start_us < a.start_us GROUP BY a.id),
l AS (SELECT a.id, avg(b.p) AS p_lane FROM m a LEFT JOIN m b ON a.entity = b.entity AND a.lane = b.lane AND b.start_us >= a.start_us - 30 * $DAY AND b.start_us < a.start_us GROUP BY a.id),
r AS (SELECT a.id, count(b.id) AS out_rate FROM m a LEFT JOIN m b ON a.entity = b.entity AND b.start_us > a.start_us - 5 * $DAY AND b.start_us <= a.start_us GROUP BY a.id),
i AS (SELECT a.id, count(b.id) AS in_rate FROM m a LEFT JOIN ins b ON a.entity = b.entity AND b.moved_us > a.start_us - 5 * $DAY AND b.moved_us <= a.start_us GROUP BY a.id)
SELECT outs.id, n_prev, round(p_mean, 6) AS p_mean, round(p_lane, 6) AS p_lane, out_rate, in_rate, round(out_rate / (in_rate + 1), 6) AS out_in_ratio
FROM outs LEFT JOIN e USING (id) LEFT JOIN l USING (id) LEFT JOIN r USING (id) LEFT JOIN i USING (id)""",
)
def w21(spark, folder):
    """Bank at the start clock: strict trailing means of durations, start and arrival rates and their ratio; null without that clock."""
    m = moves(spark, folder).select("id", "entity", "lane", "moved_us", "start_us", "phase", seconds_between("moved_us", "start_us").cast("double").alias("p"))
    o = m.where("phase = 'OUT' AND start_us IS NOT NULL")
    i = m.where("phase = 'IN'")
    got = trailing(
        o, ["entity"], "start_us",
        [events(o, ["entity"], "start_us", n=F.lit(1), p="p"), events(i, ["entity"], "moved_us", a=F.lit(1))],
        [before("n_prev", "sum", "n", 30 * DAY), before("_p", "sum", "p", 30 * DAY), until("out_rate", "sum", "n", 5 * DAY), until("in_rate", "sum", "a", 5 * DAY)],
    )
    keys = ["entity", "lane"]
    got = trailing(got, keys, "start_us", [events(o, keys, "start_us", n=F.lit(1), p="p")], [before("_ln", "sum", "n", 30 * DAY), before("_lp", "sum", "p", 30 * DAY)], base=o)
    got = m.where("phase = 'OUT'").select("id").join(got.drop("entity", "lane", "moved_us", "start_us", "phase", "p"), "id", "left")
    return got.select(
        "id", "n_prev", F.round(ratio(F.col("_p"), F.col("n_prev")), 6).alias("p_mean"), F.round(ratio(F.col("_lp"), F.col("_ln")), 6).alias("p_lane"),
        "out_rate", "in_rate", F.round(F.col("out_rate") / (F.col("in_rate") + 1), 6).alias("out_in_ratio"),
    )


@query(
    "w22_lane_headway_service",
    """WITH $MOVES, h AS (SELECT *, (moved_us - lag(moved_us) OVER o) / 1e6 AS headway FROM outs WINDOW o AS (PARTITION BY entity, lane ORDER BY moved_us, id)),
m AS (SELECT *, median(headway) OVER r5 AS med5, median(headway) OVER r20 AS med20 FROM h
  WINDOW r5 AS (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), r20 AS (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT m.*, (SELECT count(*) FROM outs b WHERE b.entity = m.entity AND b.lane = m.lane AND b.start_us <= m.moved_us)
    - (SELECT count(*) FROM outs b WHERE b.entity = m.entity AND b.lane = m.lane AND b.start_us IS NOT NULL AND b.moved_us <= m.moved_us) AS active,
  (SELECT count(*) FROM outs b WHERE b.entity = m.entity AND b.lane = m.lane AND b.start_us > m.moved_us - 30 * $DAY AND b.start_us <= m.moved_us) AS entering,
  (SELECT count(*) FROM outs b WHERE b.entity = m.entity AND b.lane = m.lane AND b.moved_us > m.moved_us - 30 * $DAY AND b.moved_us <= m.moved_us) AS served FROM m)
SELECT id, med5, med20, round(60 / greatest(med5, 1), 6) AS rate5, active, entering - served AS backlog_30d, active * greatest(med5, 60) AS expected_wait,
  round(active / nullif(60 / greatest(med20, 1), 0), 3) AS demand_supply FROM s""",
)
def w22(spark, folder):
    """Lane headway medians, service rates, expected wait and backlog."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us", "start_us")
    keys = ["entity", "lane"]
    got = traffic.headway_service(o, keys, ["moved_us", "id"], (5, 20))
    begun = events(o, keys, "start_us", b=F.lit(1))
    done = events(o, keys, "moved_us", d=F.when(F.col("start_us").isNotNull(), 1), n=F.lit(1))
    got = trailing(
        got, keys, "moved_us", [begun, done],
        [Feature("_b", "sum", "b", None, 0), Feature("_d", "sum", "d", None, 0), until("_in", "sum", "b", 30 * DAY), until("_out", "sum", "n", 30 * DAY)],
        base=o,
    )
    active = F.col("_b") - F.col("_d")
    return got.select(
        "id", F.col("headway_med5").alias("med5"), F.col("headway_med20").alias("med20"), F.round("rate5", 6).alias("rate5"), active.alias("active"),
        (F.col("_in") - F.col("_out")).alias("backlog_30d"),
        F.when(F.col("headway_med5").isNull(), active * F.lit(60.0)).otherwise(active * F.greatest(F.col("headway_med5"), F.lit(60.0))).alias("expected_wait"),
        F.round(ratio(active, F.col("rate20")), 3).alias("demand_supply"),
    )
