"""Equi, as-of, previous-event, nearest and linkage joins; template contract; scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import clock, rows
from eventloom.functions.clock import DAY, HOUR, SECOND, epoch_us, seconds_between
from eventloom.operators import asof as joins
from eventloom.operators import traffic
from eventloom.operators.robust import safe_corr
from eventloom.operators.timeline import events
from eventloom.plans.registry import query
from eventloom.plans.tables import ins, moves, outs, ticks
from eventloom.sources.readers import read_table
from eventloom.sources.writers import fill_template, splice, template_report


@query("j01_lookup_join", "SELECT l_returnflag, n_name, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def j01(spark, folder):
    """Left joins to lookup tables; Spark broadcasts them only below its size threshold."""
    li = read_table(spark, folder, "lineitem", ["l_suppkey", "l_returnflag", "l_quantity"])
    sup = read_table(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    nat = read_table(spark, folder, "nation", ["n_nationkey", "n_name"])
    # rows are reduced per supplier before they meet the lookups
    pre = li.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    got = pre.join(sup, pre.l_suppkey == sup.s_suppkey, "left").join(nat, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return got.groupBy("l_returnflag", "n_name").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@query("j02_inner_join", "SELECT o_orderstatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 250000 GROUP BY o_orderstatus")
def j02(spark, folder):
    """Inner join on the key with a pushed-down filter."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"]).where("o_totalprice > 250000")
    li = read_table(spark, folder, "lineitem", ["l_orderkey", "l_quantity"])
    return o.join(li, o.o_orderkey == li.l_orderkey).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("j03_anti_join", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_orderstatus")
def j03(spark, folder):
    """Ids without a counterpart."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus"])
    li = read_table(spark, folder, "lineitem", ["l_orderkey"])
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_anti").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("j04_semi_join", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderstatus")
def j04(spark, folder):
    """Ids with a counterpart, each once."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_orderstatus"])
    li = read_table(spark, folder, "lineitem", ["l_orderkey", "l_returnflag"]).where("l_returnflag = 'R'")
    return o.join(li, o.o_orderkey == li.l_orderkey, "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j05_asof_with_ties",
    """WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS k, epoch_us(o_orderdate) AS t, o_orderstatus AS s, o_custkey AS c FROM orders),
r AS (SELECT k, t, max_by(c, id) AS c, max(id) AS rid FROM o WHERE s = 'P' GROUP BY k, t)
SELECT l.id, r.rid AS hit_id, r.c AS hit_cust, (l.t - r.t) // $DAY AS age_days FROM (SELECT * FROM o WHERE s <> 'P') l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.t""",
)
def j05(spark, folder):
    """Backward as-of join on day-granular clocks full of ties."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
    o = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("k"), epoch_us("o_orderdate").alias("t"), F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c"))
    got = joins.asof(o.where("s <> 'P'"), o.where("s = 'P'"), ["k"], "t", "t", {"hit_id": "id", "hit_cust": "c", "rt": "t"}, tie="id")
    return got.select("id", "hit_id", "hit_cust", F.floor((F.col("t") - F.col("rt")) / F.lit(DAY)).alias("age_days"))


@query(
    "j06_j07_asof_two_clocks",
    """WITH $MOVES, a AS (SELECT o.id, r.id AS by_move, o.moved_us - r.moved_us AS age FROM outs o ASOF LEFT JOIN ins r ON o.entity = r.entity AND o.slot = r.slot AND o.moved_us >= r.moved_us),
b AS (SELECT o.id, r.id AS by_start, o.start_us - r.moved_us AS age FROM outs o ASOF LEFT JOIN ins r ON o.entity = r.entity AND o.slot = r.slot AND o.start_us >= r.moved_us)
SELECT a.id, CASE WHEN a.age <= 200 * $DAY THEN by_move END AS by_move, CASE WHEN b.age <= 200 * $DAY THEN by_start END AS by_start FROM a JOIN b USING (id)""",
)
def j06(spark, folder):
    """As-of on two reference clocks, matches beyond a validity window blanked."""
    o, i = outs(spark, folder), ins(spark, folder)
    o = o.select("id", "entity", "slot", "moved_us", "start_us")
    keys, window = ["entity", "slot"], (0, 200 * DAY)
    got = joins.asof(o, i, keys, "moved_us", "moved_us", {"by_move": "id"}, tie="id", within_us=window)
    return joins.asof(got, i, keys, "start_us", "moved_us", {"by_start": "id"}, tie="id", within_us=window, base=o).select("id", "by_move", "by_start")


@query("j08_asof_other_key", "WITH $MOVES SELECT o.id, r.y AS lane_y FROM outs o ASOF LEFT JOIN ins r ON o.entity = r.entity AND o.lane = r.lane AND o.moved_us >= r.moved_us")
def j08(spark, folder):
    """As-of by another key."""
    return joins.asof(outs(spark, folder).select("id", "entity", "lane", "moved_us"), ins(spark, folder), ["entity", "lane"], "moved_us", "moved_us", {"lane_y": "y"}, tie="id").select("id", "lane_y")


@query("j09_previous_event", "WITH $MOVES SELECT o.id, r.id AS prev_id, r.y AS prev_y, (o.moved_us - r.moved_us) // $SECOND AS since FROM outs o ASOF LEFT JOIN outs r ON o.entity = r.entity AND o.slot = r.slot AND o.moved_us > r.moved_us")
def j09(spark, folder):
    """Previous event of the same keys; a row never meets itself."""
    o = outs(spark, folder).select("id", "entity", "slot", "moved_us", "y")
    got = joins.previous_event(o, ["entity", "slot"], "moved_us", {"prev_id": "id", "prev_y": "y", "prev_us": "moved_us"}, tie="id")
    return got.select("id", "prev_id", "prev_y", seconds_between("moved_us", "prev_us").alias("since"))


@query(
    "j11_nearest_in_range",
    """WITH $MOVES, p AS (SELECT o.id, r.id AS hit, r.moved_us - o.moved_us AS gap, row_number() OVER (PARTITION BY o.id ORDER BY abs(r.moved_us - o.moved_us), r.id) AS k FROM outs o JOIN ins r ON o.slot = r.slot AND r.moved_us > o.moved_us - 20 * $DAY AND r.moved_us < o.moved_us + 5 * $DAY)
SELECT o.id, p.hit, p.gap // $SECOND AS gap FROM outs o LEFT JOIN p ON o.id = p.id AND p.k = 1""",
)
def j11(spark, folder):
    """The nearest counterpart inside an asymmetric open time range."""
    o, i = outs(spark, folder).select("id", "slot", "moved_us"), ins(spark, folder).select("id", "slot", "moved_us")
    got = joins.nearest_in_range(o, i, ["slot"], "moved_us", "id", "moved_us", -20 * DAY + 1, 5 * DAY - 1, {"hit": "id", "hit_us": "moved_us"})
    return got.select("id", "hit", seconds_between("hit_us", "moved_us").alias("gap"))


@query("j12_exists_in_range", "WITH $MOVES SELECT o.id, EXISTS (SELECT 1 FROM ins r WHERE r.slot = o.slot AND r.moved_us BETWEEN o.moved_us - 20 * $DAY AND o.moved_us + 5 * $DAY) AS near FROM outs o")
def j12(spark, folder):
    """Whether any counterpart lies inside a time range."""
    o = outs(spark, folder).select("id", "slot", "moved_us")
    return joins.exists_in_range(o, ins(spark, folder).select("slot", "moved_us"), ["slot"], "moved_us", "moved_us", -20 * DAY, 5 * DAY, "near").select("id", "near")


@query(
    "j13_lookback_link",
    """WITH $MOVES, p AS (SELECT o.id, r.id AS hit, row_number() OVER (PARTITION BY o.id ORDER BY r.moved_us DESC, r.id DESC) AS k FROM outs o JOIN ins r ON o.entity = r.entity AND o.slot = r.slot AND r.moved_us <= o.start_us AND r.moved_us >= o.start_us - 60 * $DAY)
SELECT o.id, p.hit FROM outs o LEFT JOIN p ON o.id = p.id AND p.k = 1""",
)
def j13(spark, folder):
    """The latest earlier event inside a look-back."""
    o = outs(spark, folder).select("id", "entity", "slot", "start_us")
    return joins.asof(o, ins(spark, folder), ["entity", "slot"], "start_us", "moved_us", {"hit": "id"}, tie="id", within_us=(0, 60 * DAY)).select("id", "hit")


@query("j14_previous_bin", "WITH $TICKS, b AS (SELECT entity, at_us // (6 * $HOUR) AS bin, count(*) AS n FROM ticks GROUP BY ALL) SELECT a.entity, a.bin, coalesce(p.n, a.n) AS prev_n FROM b a LEFT JOIN b p ON a.entity = p.entity AND p.bin = a.bin - 1")
def j14(spark, folder):
    """The previous time bin's value, else the own one."""
    b = ticks(spark, folder).groupBy("entity", clock.whole_div(F.col("at_us"), 6 * HOUR).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return joins.previous_bin(b, ["entity"], "bin", "n", "prev_n").select("entity", "bin", "prev_n")


@query("j16_splice", "WITH $MOVES SELECT id, CASE WHEN lane = '3' AND matched THEN (moved_us - start_us) / 1e6 ELSE y END AS p FROM outs")
def j16(spark, folder):
    """Predictions replaced by key where a patch has them."""
    o = outs(spark, folder)
    patch = o.where("lane = '3'").select("id", ((F.col("moved_us") - F.col("start_us")) / F.lit(SECOND)).alias("p"))
    return splice(o.select("id", F.col("y").alias("p")), patch, "id", "p").select("id", "p")


@query(
    "j17_template_report",
    """WITH $MOVES, t AS (SELECT id FROM outs), p AS (SELECT id, CASE WHEN matched THEN y END AS v FROM moves WHERE phase = 'OUT' AND kind <> 2 UNION ALL SELECT id, y FROM ins WHERE kind = 3 UNION ALL SELECT id, y FROM outs WHERE kind = 1)
SELECT (SELECT count(*) FROM t) AS template_rows, (SELECT count(*) FROM p) AS predicted_rows, (SELECT count(*) FROM (SELECT id FROM p GROUP BY id HAVING count(*) > 1)) AS duplicate_ids, (SELECT count(*) FROM p WHERE v IS NULL) AS null_values,
  (SELECT count(*) FROM p WHERE v < 1000 OR v > 150000) AS out_of_range, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM p)) AS missing_ids, (SELECT count(DISTINCT id) FROM p WHERE id NOT IN (SELECT id FROM t)) AS extra_ids""",
)
def j17(spark, folder):
    """Violation counters of a prediction table against its template."""
    m = moves(spark, folder)
    o = m.where("phase = 'OUT'")
    p = o.where("kind <> 2").select("id", F.when(F.col("matched"), F.col("y")).alias("v"))
    p = p.unionByName(m.where("phase = 'IN' AND kind = 3").select("id", F.col("y").alias("v"))).unionByName(o.where("kind = 1").select("id", F.col("y").alias("v")))
    return template_report(o, p, "id", "v", 1000.0, 150000.0)


@query("j17b_fill_template", "WITH $MOVES SELECT id, CASE WHEN matched THEN y END AS v FROM outs")
def j17b(spark, folder):
    """The template filled, rows without a prediction kept."""
    o = outs(spark, folder)
    return fill_template(o, o.where("matched").select("id", F.col("y").alias("v")), "id", "v")


@query(
    "j18_pairs_by_id",
    """SELECT l_orderkey AS pair_id, min_by(l_returnflag, (epoch_us(l_shipdate), l_linenumber, l_partkey)) AS a_flag, max_by(l_returnflag, (epoch_us(l_shipdate), l_linenumber, l_partkey)) AS b_flag,
  (max(epoch_us(l_shipdate)) - min(epoch_us(l_shipdate))) // $DAY AS days FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2""",
)
def j18(spark, folder):
    """Ids with exactly two rows, earlier and later row side by side."""
    li = read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"])
    li = li.withColumn("at", epoch_us("l_shipdate")).withColumnRenamed("l_orderkey", "pair_id")
    got = joins.pair_by_id(li, "pair_id", ["at", "l_linenumber", "l_partkey"], {"flag": "l_returnflag", "at": "at"})
    return got.select("pair_id", "a_flag", "b_flag", F.floor((F.col("b_at") - F.col("a_at")) / F.lit(DAY)).alias("days"))


@query(
    "j19_turnaround_link",
    """WITH $MOVES, j AS (SELECT o.id, o.kind % 2 AS k, o.y, r.kind % 2 AS rk, r.y AS ry, (o.start_us - r.moved_us) / 1e6 AS turn FROM (SELECT * FROM outs WHERE start_us IS NOT NULL) o ASOF LEFT JOIN ins r ON o.entity = r.entity AND o.slot = r.slot AND o.start_us >= r.moved_us)
SELECT count(*) AS n, count(turn) AS linked, count(*) FILTER (WHERE k = rk) AS same_kind, count(*) FILTER (WHERE k = rk AND turn BETWEEN 86400 AND 8640000) AS plausible,
  round(corr(y, ry) FILTER (WHERE k = rk AND turn BETWEEN 86400 AND 8640000), 6) AS corr_y, round(corr(y, turn) FILTER (WHERE k = rk AND turn BETWEEN 86400 AND 8640000), 6) AS corr_turn FROM j""",
)
def j19(spark, folder):
    """Link of an arrival to the next departure on its slot, plausibility window, correlations."""
    o = outs(spark, folder).where("start_us IS NOT NULL").select("id", "entity", "slot", "kind", "start_us", "y")
    got = joins.asof(o, ins(spark, folder), ["entity", "slot"], "start_us", "moved_us", {"rk": "kind", "ry": "y", "r_us": "moved_us"}, tie="id")
    turn = (F.col("start_us") - F.col("r_us")) / F.lit(SECOND)
    same = F.col("kind") % 2 == F.col("rk") % 2
    good = same & turn.between(86400, 8640000)
    y = F.when(good, F.col("y"))
    return got.agg(
        F.count(F.lit(1)).alias("n"), F.count("r_us").alias("linked"), F.count_if(same).alias("same_kind"), F.count_if(good).alias("plausible"),
        F.round(safe_corr(y, F.col("ry")), 6).alias("corr_y"), F.round(safe_corr(y, turn), 6).alias("corr_turn"),
    )


@query(
    "p01_p02_p06_clock_bank",
    "WITH $MOVES SELECT id, " + ", ".join(f"({a} - {b}) // $SECOND AS {a[:-3]}_{b[:-3]}" for a, b in (("moved_us", "start_us"), ("moved_us", "filed_us"), ("start_us", "filed_us"), ("filed_us", "lodged_us"))) + ", abs((start_us - filed_us) // $SECOND) AS abs_push, CASE WHEN start_us IS NOT NULL THEN least(greatest((start_us - filed_us) // $SECOND, -1000), 1000) END AS clipped FROM moves",
)
def p01(spark, folder):
    """A bank of clock differences, absolute value and clip."""
    pairs = {f"{a[:-3]}_{b[:-3]}": (a, b) for a, b in (("moved_us", "start_us"), ("moved_us", "filed_us"), ("start_us", "filed_us"), ("filed_us", "lodged_us"))}
    push = seconds_between("start_us", "filed_us")
    return moves(spark, folder).select("id", *clock.clock_differences(pairs), F.abs(push).alias("abs_push"), rows.clip(push, -1000, 1000).cast("long").alias("clipped"))


CLOCKS = ["start_us", "filed_us", "lodged_us", "planned_us"]


@query(
    "p03_p04_p05_clock_statistics",
    """WITH $MOVES, c AS (SELECT *, [start_us, filed_us, lodged_us, planned_us] AS l FROM moves)
SELECT id, list_count(l) AS n_clocks, list_max(l) - list_min(l) AS range_us, round(list_aggregate(list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: (x - planned_us) / 1e6), 'stddev_pop'), 3) AS std_s,
  round(list_aggregate(list_transform(list_filter(l, lambda x: x IS NOT NULL), lambda x: (x - planned_us) / 1e6), 'median'), 6) AS median_after_plan, start_us = list_max(l) AS start_latest, start_us = list_min(l) AS start_earliest FROM c""",
)
def p03(spark, folder):
    """Count, range, spread and median of a row's clocks, latest and earliest flags."""
    after = [(F.col(c) - F.col("planned_us")) / F.lit(float(SECOND)) for c in CLOCKS]
    top, low = F.greatest(*CLOCKS), F.least(*CLOCKS)
    return moves(spark, folder).select(
        "id", rows.row_count(*CLOCKS).cast("long").alias("n_clocks"), rows.row_range(*CLOCKS).alias("range_us"), F.round(rows.row_std(*after), 3).alias("std_s"),
        F.round(rows.row_median(*after), 6).alias("median_after_plan"), (F.col("start_us") == top).alias("start_latest"), (F.col("start_us") == low).alias("start_earliest"),
    )


@query(
    "p07_p08_p10_calendar",
    """WITH $MOVES, c AS (SELECT id, make_timestamp(coalesce(start_us, moved_us)) AS t, make_timestamp(moved_us) AS m FROM moves)
SELECT id, CAST(hour(t) AS INT) AS hour, CAST(isodow(t) AS INT) AS dow, CAST(month(m) AS INT) AS month, CAST(t AS DATE) AS day, CAST(hour(t) // 3 AS INT) AS hour_bucket, round(sin(2 * pi() * hour(t) / 24), 6) + 0 AS hour_sin, round(cos(2 * pi() * isodow(t) / 7), 6) + 0 AS dow_cos FROM c""",
)
def p07(spark, folder):
    """Calendar of a coalesced clock, hour bucket and cyclic encodings."""
    m = moves(spark, folder)
    cal = clock.calendar(F.coalesce("start_us", "moved_us"))
    sine, _ = clock.cyclic(cal["hour"].cast("double"), 24)
    _, cosine = clock.cyclic(cal["dow"].cast("double"), 7)
    return m.select(
        "id", cal["hour"].alias("hour"), cal["dow"].alias("dow"), clock.month_of("moved_us").alias("month"), cal["day"].alias("day"), cal["hour_bucket"].alias("hour_bucket"),
        (F.round(sine, 6) + F.lit(0.0)).alias("hour_sin"), (F.round(cosine, 6) + F.lit(0.0)).alias("dow_cos"),
    )


@query(
    "p09_marked_days",
    """WITH $MOVES, d AS (SELECT DISTINCT entity, CAST(make_timestamp(moved_us) AS DATE) AS day FROM ins WHERE kind = 3) SELECT o.id, EXISTS (SELECT 1 FROM d WHERE d.entity = o.entity AND d.day = CAST(make_timestamp(coalesce(o.start_us, o.moved_us)) AS DATE)) AS marked FROM outs o""",
)
def p09(spark, folder):
    """Flag of days listed per entity, by a join to the list."""
    from eventloom.functions.holidays import flag_days

    days = ins(spark, folder).where("kind = 3").select("entity", clock.date_of("moved_us").alias("day"))
    return flag_days(outs(spark, folder), days, "entity", clock.date_of(F.coalesce("start_us", "moved_us")), "marked").select("id", "marked")


@query(
    "p13_p16_strings",
    """SELECT p_partkey, substr(coalesce(p_type, 'NA'), 1, 3) AS family, upper(replace(p_name, ' ', '')) AS code,
  CASE WHEN regexp_replace(upper(regexp_extract(p_name, '^[A-Za-z]*', 0)), '[LR]$', '') = '' THEN 'NUM' ELSE regexp_replace(upper(regexp_extract(p_name, '^[A-Za-z]*', 0)), '[LR]$', '') END AS zone, starts_with(p_brand, 'Brand#1') AS brand1,
  CAST(regexp_matches(upper(p_type), 'ECO|PROMO') AS INT) AS marked, CAST(p_size < 10 AS INT) AS small FROM part""",
)
def p13(spark, folder):
    """Prefix keys, plain codes, zones by pattern, prefix and pattern flags."""
    p = read_table(spark, folder, "part", ["p_partkey", "p_name", "p_type", "p_brand", "p_size"])
    return p.select(
        "p_partkey", rows.prefix_key("p_type", 3).alias("family"), rows.plain_code("p_name").alias("code"), rows.zone_of("p_name").alias("zone"),
        F.col("p_brand").startswith("Brand#1").alias("brand1"), F.upper("p_type").rlike("ECO|PROMO").cast("int").alias("marked"), (F.col("p_size") < 10).cast("int").alias("small"),
    )


@query(
    "p18_p19_p20_flags_and_logs",
    """WITH $MOVES SELECT id, CAST(start_us IS NULL AS INT) AS start_missing, CASE WHEN phase = 'OUT' THEN filed_us END AS out_filed_us, round(ln(1 + least(greatest(y, 0), 86400)), 6) AS log_gap, round(greatest(y - 90000, 0), 6) AS above FROM moves""",
)
def p18(spark, folder):
    """Missing flags, values blanked by phase, log of a clipped gap."""
    return moves(spark, folder).select(
        "id", F.col("start_us").isNull().cast("int").alias("start_missing"), F.when(F.col("phase") == "OUT", F.col("filed_us")).alias("out_filed_us"),
        F.round(rows.log_gap(F.col("y")), 6).alias("log_gap"), F.round(rows.relu(F.col("y") - 90000), 6).alias("above"),
    )


@query(
    "j10_w25_key_bank",
    """WITH $MOVES SELECT o.id, """
    + ", ".join(f"(SELECT count(*) FROM outs b WHERE b.entity = o.entity AND b.{k} = o.{k} AND b.moved_us >= o.moved_us - 90 * $DAY AND b.moved_us < o.moved_us) AS n_{k}" for k in ("lane", "slot", "kind"))
    + """, (SELECT count(*) FROM ins b WHERE b.entity = o.entity AND b.moved_us > o.moved_us - 90 * $DAY AND b.moved_us <= o.moved_us) AS n_in, CASE WHEN (SELECT count(*) FROM ins b WHERE b.entity = o.entity AND b.moved_us > o.moved_us - 90 * $DAY AND b.moved_us <= o.moved_us) > 20 THEN 'busy' ELSE 'calm' END AS state FROM outs o""",
)
def j10(spark, folder):
    """One bank of trailing counts over several keys and streams, with a state label."""
    from eventloom.operators.timeline import trailing, until

    o = outs(spark, folder).select("id", "entity", "lane", "slot", "kind", "moved_us")
    got = o
    for k in ("lane", "slot", "kind"):
        got = traffic.surface_counts(got, ["entity", k], "moved_us", {f"n_{k}": o}, {"w": 90 * DAY}, since=False, base=o).withColumnRenamed(f"n_{k}_w", f"n_{k}")
    i = ins(spark, folder).select("entity", "moved_us")
    got = trailing(got, ["entity"], "moved_us", [events(i, ["entity"], "moved_us", n=F.lit(1))], [until("n_in", "sum", "n", 90 * DAY)], base=o)
    return got.select("id", "n_lane", "n_slot", "n_kind", "n_in", F.when(F.col("n_in") > 20, "busy").otherwise("calm").alias("state"))


