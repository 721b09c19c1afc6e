"""Window-boundary conventions: one query per convention."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import DAY, HOUR, seconds_between
from eventloom.operators.rowframes import full_only, over_rows, previous_row_windows
from eventloom.operators.timeline import Feature, before, between_open, closed, events, trailing, until
from eventloom.plans.registry import query
from eventloom.plans.tables import ins, outs, ticks


@query(
    "b1_strictly_before",
    """WITH $TICKS
SELECT id, count(*) OVER d AS n_1d, count(*) OVER h AS n_6h, sum(v) OVER d AS sum_1d,
  at_us - max(at_us) OVER e AS since_us
FROM ticks WINDOW
  d AS (PARTITION BY entity ORDER BY at_us RANGE BETWEEN $DAY PRECEDING AND 1 PRECEDING),
  h AS (PARTITION BY entity ORDER BY at_us RANGE BETWEEN 6 * $HOUR PRECEDING AND 1 PRECEDING),
  e AS (PARTITION BY entity ORDER BY at_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def b1(spark, folder):
    """Counts in [t - w, t) and the time since the last event."""
    t = ticks(spark, folder)
    s = events(t, ["entity"], "at_us", n=F.lit(1), v="v", seen="at_us")
    got = trailing(
        t.select("id", "entity", "at_us"),
        ["entity"],
        "at_us",
        [s],
        [before("n_1d", "sum", "n", DAY), before("n_6h", "sum", "n", 6 * HOUR), before("sum_1d", "sum", "v", DAY), before("last", "max", "seen", None)],
    )
    return got.select("id", "n_1d", "n_6h", F.when(F.col("n_1d") > 0, F.col("sum_1d")).alias("sum_1d"), (F.col("at_us") - F.col("last")).alias("since_us"))


@query(
    "b2_through_now_minus_self",
    """WITH $MOVES
SELECT id, count(*) OVER a - 1 AS n_10d, count(*) OVER b - 1 AS n_30d, count(*) OVER c - 1 AS lane_30d
FROM outs WINDOW
  a AS (PARTITION BY entity ORDER BY moved_us RANGE BETWEEN 10 * $DAY - 1 PRECEDING AND CURRENT ROW),
  b AS (PARTITION BY entity ORDER BY moved_us RANGE BETWEEN 30 * $DAY - 1 PRECEDING AND CURRENT ROW),
  c AS (PARTITION BY entity, lane ORDER BY moved_us RANGE BETWEEN 30 * $DAY - 1 PRECEDING AND CURRENT ROW)""",
)
def b2(spark, folder):
    """Counts in (t - w, t] without the row itself, per entity and per lane."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us")
    one = F.lit(1)
    got = trailing(
        o, ["entity"], "moved_us", [events(o, ["entity"], "moved_us", n=one)],
        [until("n_10d", "sum", "n", 10 * DAY), until("n_30d", "sum", "n", 30 * DAY)],
    )
    got = trailing(
        got, ["entity", "lane"], "moved_us", [events(o, ["entity", "lane"], "moved_us", n=one)],
        [until("lane_30d", "sum", "n", 30 * DAY)],
        base=o,
    )
    return got.select("id", *[(F.col(c) - 1).alias(c) for c in ("n_10d", "n_30d", "lane_30d")])


@query(
    "b3_closed_at_query_clock",
    """WITH $MOVES, q AS (SELECT *, coalesce(start_us, moved_us) AS at FROM outs)
SELECT a.id, count(b.id) FILTER (WHERE b.start_us >= a.at - 10 * $DAY) AS n_10d, count(b.id) AS n_15d
FROM q a LEFT JOIN outs b ON a.entity = b.entity AND a.lane = b.lane AND b.id <> a.id
  AND b.start_us BETWEEN a.at - 15 * $DAY AND a.at
GROUP BY a.id""",
)
def b3(spark, folder):
    """Closed interval at a query clock that falls back to another one, own event excluded."""
    o = outs(spark, folder).select("id", "entity", "lane", "start_us", F.coalesce("start_us", "moved_us").alias("at"))
    s = events(o, ["entity", "lane"], "start_us", n=F.lit(1))
    got = trailing(o, ["entity", "lane"], "at", [s], [closed("n_10d", "sum", "n", 10 * DAY), closed("n_15d", "sum", "n", 15 * DAY)])
    own = F.col("start_us").isNotNull().cast("long")
    return got.select("id", (F.col("n_10d") - own).alias("n_10d"), (F.col("n_15d") - own).alias("n_15d"))


@query(
    "b4_open_interval_per_row",
    """WITH $MOVES
SELECT a.id, count(b.id) AS inside
FROM outs a LEFT JOIN ins b ON a.entity = b.entity AND b.moved_us > a.planned_us AND b.moved_us < a.moved_us
GROUP BY a.id""",
)
def b4(spark, folder):
    """Events strictly inside each row's own interval, as a difference of running counts."""
    o = outs(spark, folder).select("id", "entity", "planned_us", "moved_us")
    s = events(ins(spark, folder), ["entity"], "moved_us", n=F.lit(1))
    return between_open(o, ["entity"], "planned_us", "moved_us", s, {"inside": "n"}).select("id", "inside")


@query(
    "b5_last_rows_all_present",
    """WITH $MOVES, x AS (SELECT *, (moved_us - start_us) / $SECOND.0 AS taken FROM outs)
SELECT id, lag(taken) OVER o AS lag1,
  CASE WHEN count(taken) OVER r5 = 5 THEN round(avg(taken) OVER r5, 6) END AS mean5,
  CASE WHEN count(taken) OVER r10 = 10 THEN median(taken) OVER r10 END AS med10
FROM x WINDOW o AS (PARTITION BY entity ORDER BY moved_us, id),
  r5 AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  r10 AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def b5(spark, folder):
    """Last n rows without the current one, null unless all n values are present."""
    o = outs(spark, folder).select("id", "entity", "moved_us", seconds_between("moved_us", "start_us").cast("double").alias("taken"))
    got = over_rows(
        o, ["entity"], ["moved_us", "id"], 10,
        {
            "lag1": lambda r: r.lag("taken"),
            "mean5": lambda r: full_only(F.round(F.avg("taken").over(r(-5, -1)), 6), "taken", r(-5, -1), 5),
            "med10": lambda r: full_only(F.percentile("taken", 0.5).over(r(-10, -1)), "taken", r(-10, -1), 10),
        },
    )
    return got.select("id", "lag1", "mean5", "med10")


@query(
    "b6_last_rows_any_present",
    """WITH $MOVES, x AS (SELECT *, (filed_us - start_us) / $SECOND.0 AS early FROM outs)
SELECT id, round(avg(early) OVER r3, 6) AS mean3, round(stddev_samp(early) OVER r3, 3) AS std3, max(early) OVER r10 AS max10
FROM x WINDOW
  r3 AS (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  r10 AS (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""",
)
def b6(spark, folder):
    """Last n rows without the current one, whatever is present."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us", seconds_between("filed_us", "start_us").cast("double").alias("early"))
    got = over_rows(
        o, ["entity", "lane"], ["moved_us", "id"], 10,
        {
            "mean3": lambda r: F.round(F.avg("early").over(r(-3, -1)), 6),
            "std3": lambda r: F.round(F.stddev_samp("early").over(r(-3, -1)), 3),
            "max10": lambda r: F.max("early").over(r(-10, -1)),
        },
    )
    return got.select("id", "mean3", "std3", "max10")


@query(
    "b7_window_ending_at_previous_row",
    """WITH $TICKS, x AS (
  SELECT id, entity, at_us, avg(v) OVER w AS mean, median(v) OVER w AS med, quantile_cont(v, 0.9) OVER w AS p90, stddev_samp(v) OVER w AS std
  FROM ticks WINDOW w AS (PARTITION BY entity ORDER BY at_us RANGE BETWEEN 6 * $HOUR - 1 PRECEDING AND CURRENT ROW))
SELECT id, round(lag(mean) OVER o, 6) AS v_mean_6h, round(lag(med) OVER o, 6) AS v_med_6h, round(lag(p90) OVER o, 6) AS v_p90_6h,
  round(lag(std) OVER o, 3) AS v_std_6h
FROM x WINDOW o AS (PARTITION BY entity ORDER BY at_us, id)""",
)
def b7(spark, folder):
    """Statistics of the time window that ends at the previous row."""
    t = ticks(spark, folder).select("id", "entity", "at_us", "v")
    got = previous_row_windows(t, ["entity"], ["at_us", "id"], {"v": "v"}, {"6h": 6 * HOUR})
    return got.select("id", *[F.round(f"v_{s}_6h", 3 if s == "std" else 6).alias(f"v_{s}_6h") for s in ("mean", "med", "p90", "std")])


@query(
    "b8_everything_before",
    """WITH $MOVES
SELECT a.id, (SELECT max(b.moved_us) FROM ins b WHERE b.entity = a.entity AND b.moved_us < a.moved_us) AS last_in_us,
  (SELECT count(*) FROM ins b WHERE b.entity = a.entity AND b.moved_us < a.moved_us) AS n_in
FROM outs a""",
)
def b8(spark, folder):
    """Open-ended frames strictly before t, across two streams."""
    o = outs(spark, folder).select("id", "entity", "moved_us")
    s = events(ins(spark, folder), ["entity"], "moved_us", n=F.lit(1), seen="moved_us")
    got = trailing(o, ["entity"], "moved_us", [s], [Feature("last_in_us", "max", "seen"), Feature("n_in", "sum", "n")])
    return got.select("id", "last_in_us", "n_in")
