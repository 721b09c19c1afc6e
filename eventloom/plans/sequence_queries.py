"""Row-order features, run lengths, workloads, configurations, histories, binned states and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.arrays import array_mean
from eventloom.functions.clock import DAY, HOUR, SECOND, seconds_between
from eventloom.operators import asof as joins
from eventloom.operators import history, ranks, traffic
from eventloom.operators.rowframes import full_only, nearest_percentile, over_rows, previous_row_windows
from eventloom.operators.scan import islands, run_length, workload
from eventloom.operators.timeline import Stream
from eventloom.plans.registry import query
from eventloom.plans.tables import ins, moves, outs, ticks

TAKEN = "CAST((moved_us - start_us) // $SECOND AS DOUBLE)"
DELAY = "CAST((start_us - filed_us) // $SECOND AS DOUBLE)"


def delays(spark, folder):
    o = outs(spark, folder)
    return o.select(
        "id", "entity", "lane", "carrier", "kind", "slot", "moved_us", "start_us",
        seconds_between("moved_us", "start_us").cast("double").alias("taken"),
        seconds_between("start_us", "filed_us").cast("double").alias("delay"),
        seconds_between("moved_us", "planned_us").cast("double").alias("late"),
    )


@query(
    "w01_lagged_rolling",
    f"""WITH $MOVES, x AS (SELECT *, {TAKEN} AS t FROM outs),
y AS (SELECT *, CASE WHEN count(t) OVER r10 = 10 THEN list_sort(list(t) OVER r10) END AS l10 FROM x
  WINDOW r10 AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN count(t) OVER r5 = 5 THEN round(avg(t) OVER r5, 6) END AS mean5, CASE WHEN count(t) OVER r20 = 20 THEN round(avg(t) OVER r20, 6) END AS mean20,
  list_aggregate(l10, 'median') AS med10, round(list_aggregate(l10, 'stddev_samp'), 3) AS std10, l10[8] AS p75_10, l10[9] AS p90_10,
  lag(t) OVER lo AS lane_lag1, CASE WHEN count(t) OVER l5 = 5 THEN round(avg(t) OVER l5, 6) END AS lane_mean5
FROM y WINDOW r5 AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  r20 AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  lo AS (PARTITION BY entity, lane ORDER BY moved_us, id),
  l5 AS (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""",
)
def w01(spark, folder):
    """Lagged rolling mean, median, std and nearest p75 / p90 of the duration, by entity and lane."""
    x = delays(spark, folder).select("id", "entity", "lane", "moved_us", "taken")
    order = ["moved_us", "id"]

    def listed(fn):
        return lambda r: full_only(fn(F.collect_list("taken").over(r(-10, -1))), "taken", r(-10, -1), 10)

    got = over_rows(
        x, ["entity"], order, 20,
        {
            "mean5": lambda r: full_only(F.round(F.avg("taken").over(r(-5, -1)), 6), "taken", r(-5, -1), 5),
            "mean20": lambda r: full_only(F.round(F.avg("taken").over(r(-20, -1)), 6), "taken", r(-20, -1), 20),
            "med10": lambda r: full_only(F.percentile("taken", 0.5).over(r(-10, -1)), "taken", r(-10, -1), 10),
            "std10": lambda r: full_only(F.round(F.stddev_samp("taken").over(r(-10, -1)), 3), "taken", r(-10, -1), 10),
            "p75_10": listed(lambda a: nearest_percentile(a, 0.75)),
            "p90_10": listed(lambda a: nearest_percentile(a, 0.90)),
        },
    )
    got = over_rows(
        got, ["entity", "lane"], order, 5,
        {
            "lane_lag1": lambda r: r.lag("taken"),
            "lane_mean5": lambda r: full_only(F.round(F.avg("taken").over(r(-5, -1)), 6), "taken", r(-5, -1), 5),
        },
        base=x,
    )
    return got.select("id", "mean5", "mean20", "med10", "std10", "p75_10", "p90_10", "lane_lag1", "lane_mean5")


@query(
    "w06_entity_memory",
    f"""WITH $MOVES, x AS (SELECT *, {TAKEN} AS taken, {DELAY} AS delay FROM outs),
y AS (SELECT id, entity, moved_us, {", ".join(f"avg({c}) OVER w{w} AS {c}_mean_{w}, median({c}) OVER w{w} AS {c}_med_{w}, quantile_cont({c}, 0.9) OVER w{w} AS {c}_p90_{w}, stddev_samp({c}) OVER w{w} AS {c}_std_{w}" for c in ("taken", "delay") for w in (10, 30))}
  FROM x WINDOW {", ".join(f"w{w} AS (PARTITION BY entity ORDER BY moved_us RANGE BETWEEN {w} * $DAY - 1 PRECEDING AND CURRENT ROW)" for w in (10, 30))})
SELECT id, {", ".join(f"round(lag({c}_{s}_{w}) OVER o, {3 if s == 'std' else 6}) AS {c}_{s}_{w}" for c in ("taken", "delay") for w in (10, 30) for s in ("mean", "med", "p90", "std"))}
FROM y WINDOW o AS (PARTITION BY entity ORDER BY moved_us, id)""",
)
def w06(spark, folder):
    """Previous-row anchored statistics of several delays over several windows."""
    x = delays(spark, folder).select("id", "entity", "moved_us", "taken", "delay")
    got = previous_row_windows(x, ["entity"], ["moved_us", "id"], {"taken": "taken", "delay": "delay"}, {"10": 10 * DAY, "30": 30 * DAY})
    names = [(c, s, w) for c in ("taken", "delay") for w in (10, 30) for s in ("mean", "med", "p90", "std")]
    return got.select("id", *[F.round(f"{c}_{s}_{w}", 3 if s == "std" else 6).alias(f"{c}_{s}_{w}") for c, s, w in names])


def neighbour_features(value: str = "delay"):
    gap = lambda k: (lambda r: (F.col("moved_us") - r.lag("moved_us", k)) / F.lit(float(SECOND)))
    late = F.when(F.coalesce(F.col(value), F.lit(0.0)) > 600, 1).otherwise(0)
    return {
        "gap1": gap(1), "gap2": gap(2), "gap3": gap(3), "gap4": gap(4), "gap5": gap(5),
        "lag1": lambda r: r.lag(value),
        "mean3": lambda r: F.round(F.avg(value).over(r(-3, -1)), 6),
        "med5": lambda r: F.percentile(value, 0.5).over(r(-5, -1)),
        "p90_5": lambda r: F.round(F.percentile(value, 0.9).over(r(-5, -1)), 6),
        "n_late3": lambda r: F.sum(late).over(r(-3, -1)),
        "n_late10": lambda r: F.sum(late).over(r(-10, -1)),
        "max10": lambda r: F.max(value).over(r(-10, -1)),
    }


def neighbour_sql(keys: str) -> str:
    part = f"PARTITION BY {keys} ORDER BY moved_us, id"
    return f"""WITH $MOVES, x AS (SELECT *, {DELAY} AS delay FROM outs),
y AS (SELECT *, CASE WHEN coalesce(delay, 0) > 600 THEN 1 ELSE 0 END AS late, {", ".join(f"(moved_us - lag(moved_us, {k}) OVER o) / 1e6 AS gap{k}" for k in range(1, 6))} FROM x WINDOW o AS ({part}))
SELECT id, round(gap1, 6) AS gap1, round(list_aggregate([gap1, gap2, gap3], 'avg'), 6) AS gap_mean3, round(list_aggregate([gap1, gap2, gap3, gap4, gap5], 'median'), 6) AS gap_med5,
  round(least(gap1, gap2, gap3, gap4, gap5), 6) AS gap_min5, lag(delay) OVER o AS lag1, round(avg(delay) OVER r3, 6) AS mean3, median(delay) OVER r5 AS med5,
  round(quantile_cont(delay, 0.9) OVER r5, 6) AS p90_5, CAST(sum(late) OVER r3 AS BIGINT) AS n_late3, CAST(sum(late) OVER r10 AS BIGINT) AS n_late10, max(delay) OVER r10 AS max10
FROM y WINDOW o AS ({part}), r3 AS ({part} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r5 AS ({part} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r10 AS ({part} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def neighbours(spark, folder, keys):
    from eventloom.functions.rows import row_mean, row_median

    x = delays(spark, folder).select("id", *keys, "moved_us", "delay")
    got = over_rows(x, keys, ["moved_us", "id"], 10, neighbour_features())
    gaps = [f"gap{k}" for k in range(1, 6)]
    return got.select(
        "id", F.round("gap1", 6).alias("gap1"), F.round(row_mean(*gaps[:3]), 6).alias("gap_mean3"), F.round(row_median(*gaps), 6).alias("gap_med5"),
        F.round(F.least(*gaps), 6).alias("gap_min5"), "lag1", "mean3", "med5", "p90_5", "n_late3", "n_late10", "max10",
    )


@query("w08_w09_neighbour_state", neighbour_sql("entity"))
def w08(spark, folder):
    """Gaps to and delays of the previous rows of an entity, counts of delayed ones."""
    return neighbours(spark, folder, ["entity"])


@query("w12_lane_queue_state", neighbour_sql("entity, lane"))
def w12(spark, folder):
    """The neighbour state with the finer (entity, lane) key."""
    return neighbours(spark, folder, ["entity", "lane"])


@query(
    "w10_run_length",
    f"""WITH $MOVES, x AS (SELECT *, coalesce({DELAY}, 0) > 600 AS late, row_number() OVER (PARTITION BY entity ORDER BY moved_us, id) AS pos FROM outs),
y AS (SELECT *, sum(CASE WHEN late THEN 0 ELSE 1 END) OVER (PARTITION BY entity ORDER BY pos) AS grp FROM x),
z AS (SELECT *, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY entity, grp ORDER BY pos) AS run FROM y)
SELECT id, CAST(lag(run) OVER (PARTITION BY entity ORDER BY pos) AS BIGINT) AS run FROM z""",
)
def w10(spark, folder):
    """Length of the run of delayed rows that ended at the previous row."""
    x = delays(spark, folder).select("id", "entity", "moved_us", "delay")
    return run_length(x, ["entity"], ["moved_us", "id"], F.coalesce(F.col("delay"), F.lit(0.0)) > 600, "run").select("id", "run")


@query(
    "w11_same_as_previous",
    """WITH $MOVES, x AS (SELECT id, """
    + ", ".join(f"CAST(lag({c}, {k}) OVER o = {c} AS INT) AS {c}{k}" for c in ("lane", "carrier") for k in range(1, 6))
    + """ FROM outs WINDOW o AS (PARTITION BY entity ORDER BY moved_us, id))
SELECT id, lane1 AS same_lane, carrier1 AS same_carrier, round(list_aggregate([lane1, lane2, lane3, lane4, lane5], 'avg'), 6) AS lane_share5,
  round(list_aggregate([carrier1, carrier2, carrier3, carrier4, carrier5], 'avg'), 6) AS carrier_share5 FROM x""",
)
def w11(spark, folder):
    """Same attribute as the previous row, and its share over the last five."""
    from eventloom.functions.rows import row_mean

    x = delays(spark, folder).select("id", "entity", "moved_us", "lane", "carrier")
    got = over_rows(
        x, ["entity"], ["moved_us", "id"], 5,
        {f"{c}_{k}": (lambda r, c=c, k=k: (r.lag(c, k) == F.col(c)).cast("int")) for c in ("lane", "carrier") for k in range(1, 6)},
    )
    share = lambda c: F.round(row_mean(*[F.col(f"{c}_{k}").cast("double") for k in range(1, 6)]), 6).alias(f"{c}_share5")
    return got.select("id", F.col("lane_1").alias("same_lane"), F.col("carrier_1").alias("same_carrier"), share("lane"), share("carrier"))


@query(
    "w23_workload",
    """WITH RECURSIVE $MOVES, x AS (SELECT id, entity, lane, moved_us, row_number() OVER o AS pos, lag(moved_us) OVER o AS prev FROM outs WINDOW o AS (PARTITION BY entity, lane ORDER BY moved_us, id)),
b AS (SELECT id, entity, lane, pos, CAST(1.0 AS DOUBLE) AS load FROM x WHERE pos = 1
  UNION ALL
  SELECT x.id, x.entity, x.lane, x.pos, CASE WHEN x.moved_us - x.prev > 20 * $DAY THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, b.load + 1.0 - (x.moved_us - x.prev) / CAST(7 * $DAY AS DOUBLE)) END
  FROM b JOIN x ON x.entity = b.entity AND x.lane = b.lane AND x.pos = b.pos + 1)
SELECT id, CAST(round(load * 604800) AS BIGINT) AS load_seconds FROM b""",
)
def w23(spark, folder):
    """Reflected workload with a constant drain, restarted after a long idle gap."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us")
    got = workload(o, ["entity", "lane"], ["moved_us", "id"], F.lit(1), 7 * DAY, 20 * DAY, "load")
    return got.select("id", F.round(F.col("load") * 604800).cast("long").alias("load_seconds"))


@query(
    "w24_headway_prediction",
    """WITH $MOVES, h AS (SELECT *, (moved_us - lag(moved_us) OVER o) / 1e6 AS hw FROM outs WINDOW o AS (PARTITION BY entity, lane ORDER BY moved_us, id)),
l AS (SELECT *, list(hw) FILTER (WHERE hw IS NOT NULL) OVER (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS five,
  list(hw) FILTER (WHERE hw IS NOT NULL) OVER (PARTITION BY entity, lane ORDER BY moved_us, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS three FROM h),
p AS (SELECT *, list_aggregate(five, 'median') AS pred, list_aggregate(three, 'median') AS mid FROM l)
SELECT id, pred, CASE WHEN hw IS NOT NULL AND pred > 1 THEN round(hw / pred, 6) END AS observed_over_pred,
  CASE WHEN hw IS NOT NULL AND pred > 1 THEN round(list_sum(list_transform(three, lambda x: x - mid)), 3) END AS excess_sum3,
  CASE WHEN hw IS NOT NULL AND pred > 1 THEN round(list_max(list_transform(three, lambda x: abs(x - mid))), 3) END AS excess_max3
FROM p""",
)
def w24(spark, folder):
    """Predicted headway, observed over predicted, excess over the last three."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us")
    got = traffic.headway_excess(o, ["entity", "lane"], ["moved_us", "id"])
    return got.select(
        "id", F.col("headway_pred").alias("pred"), F.round("observed_over_pred", 6).alias("observed_over_pred"),
        F.round("excess_sum3", 3).alias("excess_sum3"), F.round("excess_max3", 3).alias("excess_max3"),
    )


@query(
    "w26_configuration_state",
    """WITH $MOVES, c AS (SELECT a.id, b.lane, count(*) AS n FROM outs a JOIN outs b ON a.entity = b.entity AND b.moved_us >= a.moved_us - 20 * $DAY AND b.moved_us < a.moved_us GROUP BY a.id, b.lane),
g AS (SELECT id, sum(n) AS total, max(n) AS top, arg_max(lane, (n, -ascii(lane))) AS dominant FROM c GROUP BY id),
e AS (SELECT c.id, -sum(c.n / g.total * ln(c.n / g.total)) AS entropy FROM c JOIN g USING (id) GROUP BY c.id),
f AS (SELECT o.id, o.entity, o.moved_us, o.lane, g.* EXCLUDE (id), e.entropy FROM outs o LEFT JOIN g ON o.id = g.id LEFT JOIN e ON o.id = e.id),
s AS (SELECT *, row_number() OVER w = 1 OR dominant IS DISTINCT FROM lag(dominant) OVER w AS change FROM f WINDOW w AS (PARTITION BY entity ORDER BY moved_us, id))
SELECT id, CAST(coalesce(total, 0) AS BIGINT) AS recent, round(top / total, 6) AS dominant_share, round(entropy, 6) + 0 AS dominant_entropy, dominant, coalesce(dominant = lane, false) AS is_dominant,
  moved_us - max(CASE WHEN change THEN moved_us END) OVER (PARTITION BY entity ORDER BY moved_us, id) AS state_age_us FROM s""",
)
def w26(spark, folder):
    """Dominant lane of the trailing window, its share and entropy, age of the state."""
    o = outs(spark, folder).select("id", "entity", "lane", "moved_us")
    got = traffic.configuration(o, ["entity"], "moved_us", "id", "lane", 20 * DAY)
    return got.select(
        "id", "recent", F.round("dominant_share", 6).alias("dominant_share"), (F.round("dominant_entropy", 6) + F.lit(0.0)).alias("dominant_entropy"),
        "dominant", "is_dominant", "state_age_us",
    )


@query(
    "w27_release_bounds",
    """WITH $MOVES, d AS (SELECT a.id, count(b.id) AS n_out, min(b.moved_us) AS t FROM outs a LEFT JOIN outs b ON a.slot = b.slot AND b.moved_us > a.planned_us AND b.moved_us < a.moved_us GROUP BY a.id),
i AS (SELECT a.id, count(b.id) AS n_in, min(b.start_us) AS t FROM outs a LEFT JOIN ins b ON a.slot = b.slot AND b.start_us > a.planned_us AND b.start_us < a.moved_us GROUP BY a.id),
f AS (SELECT o.*, n_out, n_in, least(d.t, i.t) AS first FROM outs o JOIN d ON o.id = d.id JOIN i ON o.id = i.id)
SELECT id, n_out, n_in, first IS NOT NULL AS has_first, coalesce((first - planned_us) / 1e6, greatest((moved_us - planned_us) / 1e6, 0)) AS first_after_start,
  coalesce((moved_us - first) / 1e6, 0) AS first_before_end, CAST(hour(make_timestamp(coalesce(first, moved_us))) AS INT) AS first_hour FROM f""",
)
def w27(spark, folder):
    """Events of two streams inside each row's own open interval, the first one and the bounds it sets."""
    m = moves(spark, folder).select("id", "slot", "planned_us", "moved_us", "start_us", "phase")
    o, i = m.where("phase = 'OUT'"), m.where("phase = 'IN'")
    got = traffic.release_bounds(o.select("id", "slot", "planned_us", "moved_us"), ["slot"], "planned_us", "moved_us", o, "moved_us", i, "start_us")
    return got.drop("slot", "planned_us", "moved_us")


@query(
    "w28_rank_in_reference",
    """WITH $MOVES
SELECT o.id, round((SELECT count(*) FROM ins r WHERE r.y < o.y) / (SELECT count(*) FROM ins), 6) AS rank FROM outs o""",
)
def w28(spark, folder):
    """Share of a reference distribution strictly below each value."""
    m = moves(spark, folder).select("id", "y", "phase")
    got = ranks.rank_in_reference(m.where("phase = 'OUT'"), "y", m.where("phase = 'IN'"), "y", "rank")
    return got.select("id", F.round("rank", 6).alias("rank"))


@query(
    "w29_second_previous_value",
    """WITH $MOVES, r AS (SELECT entity, slot, moved_us, id, y, lag(y) OVER (PARTITION BY entity, slot ORDER BY moved_us, id) AS y2 FROM ins)
SELECT o.id, r.y AS y1, r.y2 FROM outs o ASOF LEFT JOIN r ON o.entity = r.entity AND o.slot = r.slot AND o.moved_us >= r.moved_us""",
)
def w29(spark, folder):
    """Value of the last and the second-last arrival on the same slot."""
    o = outs(spark, folder).select("id", "entity", "slot", "moved_us")
    r = ins(spark, folder).select("id", "entity", "slot", "moved_us", "y")
    r = over_rows(r, ["entity", "slot"], ["moved_us", "id"], 1, {"before": lambda w: w.lag("y")})
    return joins.asof(o, r, ["entity", "slot"], "moved_us", "moved_us", {"y1": "y", "y2": "before"}, tie="id").select("id", "y1", "y2")


@query(
    "w30_fixed_length_history",
    """WITH $TICKS, h AS (SELECT id, at_us, kind, list({'id': id, 'at': at_us, 'kind': kind, 'v': v}) OVER (PARTITION BY entity ORDER BY at_us, id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS l FROM ticks)
SELECT id, coalesce(len(l), 0) AS n_valid, 64 - coalesce(len(l), 0) AS n_pad, l[-1].id AS newest_id, l[1].id AS oldest_id, (at_us - l[-1].at) / 1e6 AS newest_gap,
  round(ln(1 + (at_us - l[1].at) / 1e6), 6) AS oldest_log_gap, coalesce(len(list_filter(l, lambda e: e.kind = h.kind)), 0) AS same_kind,
  coalesce(list_sum(list_transform(l, lambda e: e.v)), 0) AS v_sum FROM h""",
)
def w30(spark, folder):
    """The last 64 earlier events as a left-padded array with mask and relative features."""
    t = ticks(spark, folder)
    got = history.histories(t, ["entity"], ["at_us", "id"], 64, {"id": "id", "at": "at_us", "kind": "kind", "v": "v"}, "at_us")
    real = F.filter("history", lambda e: e["valid"])
    first, last = F.try_element_at(real, F.lit(1)), F.try_element_at(real, F.lit(-1))
    return got.select(
        "id",
        F.size(real).cast("long").alias("n_valid"),
        (F.size("history") - F.size(real)).cast("long").alias("n_pad"),
        last["id"].alias("newest_id"),
        first["id"].alias("oldest_id"),
        last["gap"].alias("newest_gap"),
        F.round(first["log_gap"], 6).alias("oldest_log_gap"),
        F.size(F.filter(real, lambda e: e["kind"] == F.col("kind"))).cast("long").alias("same_kind"),
        F.aggregate(real, F.lit(0.0), lambda a, e: a + e["v"]).alias("v_sum"),
    )


@query(
    "w31_context_window",
    """WITH $MOVES, h AS (SELECT id, lane, list({'y': y, 'lane': lane, 'at': moved_us}) OVER (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS l, moved_us FROM moves),
f AS (SELECT id, lane, list_filter(l, lambda e: e.at < h.moved_us) AS l FROM h)
SELECT id, coalesce(len(l), 0) AS n_context, round(list_aggregate(list_transform(l, lambda e: e.y), 'avg'), 6) AS y_mean,
  round(len(list_filter(l, lambda e: e.lane = f.lane)) / nullif(len(l), 0), 6) AS same_lane_share FROM f""",
)
def w31(spark, folder):
    """Features of a context of the 32 previous events of both streams."""
    m = moves(spark, folder).select("id", "entity", "lane", "moved_us", "y")
    got = history.histories(m, ["entity"], ["moved_us", "id"], 32, {"y": "y", "lane": "lane"}, "moved_us")
    real = F.filter("history", lambda e: e["valid"])
    n = F.size(real)
    return got.select(
        "id", n.cast("long").alias("n_context"), F.round(array_mean(F.transform(real, lambda e: e["y"])), 6).alias("y_mean"),
        F.round(F.size(F.filter(real, lambda e: e["lane"] == F.col("lane"))) / F.nullif(n, F.lit(0)), 6).alias("same_lane_share"),
    )


@query(
    "w32_binned_state",
    """WITH $TICKS, b AS (SELECT entity, unnest(generate_series(min(at_us // $HOUR), max(at_us // $HOUR))) AS bin FROM ticks GROUP BY entity)
SELECT b.entity, b.bin, count(t.id) AS n_all, count(t.id) FILTER (WHERE t.kind = 'purchase') AS n_buy, median(t.v) AS median
FROM b LEFT JOIN ticks t ON t.entity = b.entity AND t.at_us >= b.bin * $HOUR - 3 * $HOUR AND t.at_us < b.bin * $HOUR GROUP BY b.entity, b.bin""",
)
def w32(spark, folder):
    """Dense hourly bins per entity with counts and a median of the three hours before."""
    t = ticks(spark, folder)
    counts = {
        "n_all": Stream(t, ["entity"], "at_us", {"n_all": F.lit(1)}),
        "n_buy": Stream(t, ["entity"], "at_us", {"n_buy": F.when(F.col("kind") == "purchase", 1)}),
    }
    return traffic.binned_state(t, ["entity"], "at_us", HOUR, 3 * HOUR, counts, "v")


@query(
    "w33_state_persistence",
    """WITH $TICKS, s AS (SELECT entity, kind, at_us, id, row_number() OVER (PARTITION BY entity ORDER BY at_us, id) - row_number() OVER (PARTITION BY entity, kind ORDER BY at_us, id) AS grp FROM ticks),
r AS (SELECT entity, kind, grp, count(*) AS len FROM s GROUP BY entity, kind, grp)
SELECT entity, count(*) AS runs, CAST(sum(len) AS BIGINT) AS n, round(avg(len), 6) AS mean_run, CAST(median(len) AS DOUBLE) AS median_run, round(count(*) / sum(len), 6) AS changes_per_row FROM r GROUP BY entity""",
)
def w33(spark, folder):
    """Mean and median run length and transition rate of a state sequence."""
    t = ticks(spark, folder).select("id", "entity", "kind", "at_us")
    runs = islands(t, ["entity"], ["at_us", "id"], F.col("kind")).groupBy("entity", "island").agg(F.count(F.lit(1)).alias("len"))
    stats = runs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("len").alias("n"), F.round(F.avg("len"), 6).alias("mean_run"),
        F.round(F.count(F.lit(1)) / F.sum("len"), 6).alias("changes_per_row"),
    )
    return stats.join(ranks.median_table(runs, ["entity"], "len", "median_run"), ["entity"])


@query(
    "w34_previous_same_code",
    """WITH $TICKS SELECT id, lag(v) OVER o AS prev_v, (at_us - lag(at_us) OVER o) / 1e6 AS gap FROM ticks WINDOW o AS (PARTITION BY user_id, kind ORDER BY at_us, id)""",
)
def w34(spark, folder):
    """Value of and time since the previous event of the same key."""
    t = ticks(spark, folder)
    got = over_rows(
        t, ["user_id", "kind"], ["at_us", "id"], 1,
        {"prev_v": lambda r: r.lag("v"), "gap": lambda r: (F.col("at_us") - r.lag("at_us")) / F.lit(float(SECOND))},
    )
    return got.select("id", "prev_v", "gap")


@query(
    "w35_rolling_then_asof",
    """WITH $MOVES, r AS (SELECT entity, moved_us, id, round(avg(y) OVER w, 6) AS mean10, median(y) OVER w AS med10 FROM ins
  WINDOW w AS (PARTITION BY entity ORDER BY moved_us, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT o.id, r.mean10, r.med10 FROM outs o ASOF LEFT JOIN r ON o.entity = r.entity AND o.moved_us >= r.moved_us""",
)
def w35(spark, folder):
    """Rolling statistics of one stream, read by the other stream as of its own time."""
    r = ins(spark, folder).select("id", "entity", "moved_us", "y")
    r = over_rows(
        r, ["entity"], ["moved_us", "id"], 10,
        {"mean10": lambda w: F.round(F.avg("y").over(w(-9, 0)), 6), "med10": lambda w: F.percentile("y", 0.5).over(w(-9, 0))},
    )
    o = outs(spark, folder).select("id", "entity", "moved_us")
    return joins.asof(o, r, ["entity"], "moved_us", "moved_us", {"mean10": "mean10", "med10": "med10"}, tie="id").select("id", "mean10", "med10")


@query(
    "w36_bins",
    """WITH $MOVES, e AS (SELECT """
    + ", ".join(f"quantile_cont(y, {i / 10}) AS e{i}" for i in range(11))
    + """ FROM outs)
SELECT o.id, CAST("""
    + " + ".join(f"(o.y > e.e{i})::INT" for i in range(1, 10))
    + """ AS INT) AS qbin, CAST(ntile(12) OVER (ORDER BY o.y, o.id) AS INT) AS even_bin,
  CASE WHEN o.y <= 3600 THEN 0 WHEN o.y <= 43200 THEN 1 WHEN o.y <= 86400 THEN 2 ELSE 3 END AS step FROM outs o, e""",
)
def w36(spark, folder):
    """Equal-frequency bins, equal-size bins of one global order, and a ladder of fixed edges."""
    from eventloom.functions.rows import ladder

    o = outs(spark, folder).select("id", "y")
    got = ranks.even_bins(ranks.quantile_bin(o, "y", 10, "qbin"), "y", ["id"], 12, "even_bin")
    return got.select("id", "qbin", "even_bin", ladder(F.col("y"), [3600.0, 43200.0, 86400.0], right_closed=True).alias("step"))
