"""Profiling, filters, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import date_of, epoch_us, month_of, seconds_between
from eventloom.operators import history, profile, split
from eventloom.operators.asof import keep_last
from eventloom.plans.encode_queries import train_val
from eventloom.plans.registry import query
from eventloom.plans.tables import moves, outs, ticks
from eventloom.sources.readers import join_filled, read_drifting, read_guarded, read_table, split_by_phase
from eventloom.sources.weather import decode

NULL_COLS = ["start_us", "filed_us", "lodged_us", "planned_us"]


@query("a24_null_profile", "WITH $MOVES " + " UNION ALL ".join(f"SELECT phase, '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM moves GROUP BY phase" for c in NULL_COLS))
def a24(spark, folder):
    """Nulls per column and phase."""
    return profile.null_profile(moves(spark, folder), NULL_COLS, ["phase"])


@query("a24b_null_overlap", "WITH $MOVES " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_null FROM moves" for i, a in enumerate(NULL_COLS) for b in NULL_COLS[i:]))
def a24b(spark, folder):
    """Columns that are null together."""
    return profile.null_overlap(moves(spark, folder), NULL_COLS)


@query("a25_all_null_rows", "WITH $MOVES SELECT start_us IS NULL AND filed_us IS NULL AND lodged_us IS NULL AS all_null, count(*) AS n, round(avg(y), 4) AS mean_y FROM moves GROUP BY 1")
def a25(spark, folder):
    """The class of rows whose plan columns are all null."""
    return moves(spark, folder).groupBy(profile.all_null(["start_us", "filed_us", "lodged_us"]).alias("all_null")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 4).alias("mean_y"))


@query("a26_duplicate_keys", "WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS rows, max(n) AS largest FROM g")
def a26(spark, folder):
    """Keys that occur more than once."""
    return profile.duplicate_keys(read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"])


@query("a26b_ranges", "WITH $MOVES " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS low, max({c}) AS high FROM moves" for c in ("moved_us", "start_us", "planned_us", "filed_us")))
def a26b(spark, folder):
    """First and last value of every clock."""
    return profile.ranges(moves(spark, folder), ["moved_us", "start_us", "planned_us", "filed_us"])


@query("a26c_f06_top_values", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 20")
def a26c(spark, folder):
    """The twenty most frequent values."""
    return profile.top_values(read_table(spark, folder, "lineitem", ["l_suppkey"]), "l_suppkey", 20)


@query("a27_a28_identity_audit", """WITH $MOVES, d AS (SELECT y - CAST((moved_us - filed_us) // $SECOND AS DOUBLE) AS d FROM outs WHERE filed_us IS NOT NULL)
SELECT count(*) AS n, round(avg((d = 0)::INT), 6) AS exact, count(*) FILTER (WHERE d > 0) AS above, count(*) FILTER (WHERE d < 0) AS below, round(avg(abs(d)), 4) AS mae, round(sqrt(avg(d * d)), 4) AS rmse,
  round(quantile_cont(abs(d), 0.5), 4) AS p50, round(quantile_cont(abs(d), 0.9), 4) AS p90, round(quantile_cont(abs(d), 0.95), 4) AS p95, round(quantile_cont(abs(d), 0.99), 4) AS p99 FROM d""")
def a27(spark, folder):
    """A target against a value rebuilt from other clocks."""
    o = outs(spark, folder).select("y", seconds_between("moved_us", "filed_us").cast("double").alias("rebuilt"))
    got = profile.identity_audit(o, "y", "rebuilt")
    return got.select(*[F.round(c, 6 if c == "exact" else 4).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query("a30_density", """WITH $TICKS, c AS (SELECT entity, at_us // $HOUR AS u, count(*) AS n FROM ticks GROUP BY ALL)
SELECT entity, count(*) AS units, round(avg(n), 6) AS mean, max(n) AS max, CAST(median(n) AS DOUBLE) AS median, round(quantile_cont(n, 0.95), 4) AS p95 FROM c GROUP BY entity""")
def a30(spark, folder):
    """Events per hour of each entity."""
    got = profile.density(ticks(spark, folder), ["entity"], "at_us", "hour")
    return got.select("entity", "units", F.round("mean", 6).alias("mean"), "max", "median", F.round("p95", 4).alias("p95"))


@query("a31_gap_statistics", """WITH $TICKS, g AS (SELECT entity, (at_us - lag(at_us) OVER (PARTITION BY entity ORDER BY at_us, id)) / 1e6 AS gap FROM ticks)
SELECT entity, count(gap) AS n, round(avg(gap), 4) AS mean, min(gap) AS min, round(median(gap), 4) AS median, round(quantile_cont(gap, 0.9), 4) AS p90 FROM g GROUP BY entity""")
def a31(spark, folder):
    """Gaps between consecutive events."""
    got = profile.gap_statistics(ticks(spark, folder), ["entity"], ["at_us", "id"])
    return got.select("entity", "n", F.round("mean", 4).alias("mean"), "min", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query("a32_multiplicity", "WITH g AS (SELECT l_orderkey, count(*) AS times FROM lineitem GROUP BY ALL) SELECT times, count(*) AS keys FROM g GROUP BY times")
def a32(spark, folder):
    """How often ids repeat."""
    return profile.multiplicity(read_table(spark, folder, "lineitem", ["l_orderkey"]), "l_orderkey")


@query("a33_distinct_list", "WITH $TICKS SELECT user_id, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds, count(DISTINCT kind) AS n_kinds FROM ticks GROUP BY user_id")
def a33(spark, folder):
    """Distinct values per group as one string, and their number."""
    return profile.distinct_list(ticks(spark, folder), ["user_id"], "kind", "kinds")


@query("a34_mismatches", """WITH $MOVES SELECT 'day' AS pair, count(*) FILTER (WHERE start_us IS NOT NULL) AS both, count(*) FILTER (WHERE CAST(make_timestamp(start_us) AS DATE) <> CAST(make_timestamp(moved_us) AS DATE)) AS differ FROM moves
UNION ALL SELECT 'month', count(*) FILTER (WHERE start_us IS NOT NULL), count(*) FILTER (WHERE month(make_timestamp(start_us)) <> month(make_timestamp(moved_us))) FROM moves""")
def a34(spark, folder):
    """Paired columns that differ; clocks on different days."""
    return profile.mismatches(moves(spark, folder), {"day": (date_of("start_us"), date_of("moved_us")), "month": (month_of("start_us"), month_of("moved_us"))})


@query("a35_enrichment", """WITH $MOVES, g AS (SELECT carrier, count(*) AS n, count(*) FILTER (WHERE y > 150000) AS n_sub FROM outs GROUP BY carrier HAVING count(*) >= 30), t AS (SELECT count(*) AS a, count(*) FILTER (WHERE y > 150000) AS s FROM outs)
SELECT carrier, n, n_sub, round(n_sub / s, 6) AS share_sub, round(n / a, 6) AS share_all, round((n_sub / s) / (n / a), 6) AS lift FROM g, t ORDER BY (n_sub / s) / (n / a) DESC, carrier LIMIT 12""")
def a35(spark, folder):
    """Values over-represented among extreme rows."""
    got = profile.enrichment(outs(spark, folder), "carrier", F.col("y") > 150000, 30, 12)
    return got.select("carrier", "n", "n_sub", *[F.round(c, 6).alias(c) for c in ("share_sub", "share_all", "lift")])


@query("p12_clock_resolution", """WITH $TICKS SELECT count(*) AS n, count(DISTINCT at_us) AS instants, count(DISTINCT at_us // (60 * $SECOND)) AS minutes, count(DISTINCT at_us // $HOUR) AS hours,
  round(avg((at_us % (60 * $SECOND) <> 0)::INT), 6) AS share_seconds, round(avg((at_us % $SECOND <> 0)::INT), 6) AS share_fraction FROM ticks""")
def p12(spark, folder):
    """Resolution of a clock from truncations."""
    got = profile.resolution(ticks(spark, folder), "at_us")
    return got.select("n", "instants", "minutes", "hours", F.round("share_seconds", 6).alias("share_seconds"), F.round("share_fraction", 6).alias("share_fraction"))


@query("f01_f02_holdout_split", "WITH $TV SELECT CASE WHEN month IN (1, 7) THEN 'validation' ELSE 'train' END AS part, count(*) AS n, count(*) FILTER (WHERE matched) AS n_matched, sum(y) AS sum_y FROM o GROUP BY 1")
def f01(spark, folder):
    """filters and the split by held-out months."""
    o = outs(spark, folder).withColumn("month", month_of("moved_us"))
    tr, va = split.by_period(o, "month", [1, 7])
    both = tr.withColumn("part", F.lit("train")).unionByName(va.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("n_matched"), F.sum("y").alias("sum_y"))


@query("f03_chronological_tail", "WITH $MOVES, x AS (SELECT id, row_number() OVER (ORDER BY moved_us, id) AS pos, count(*) OVER () AS n FROM outs) SELECT id, pos > floor(n * 0.85::DOUBLE) AS in_tail FROM x")
def f03(spark, folder):
    """exact chronological head and tail."""
    return split.tail_split(outs(spark, folder).select("id", "moved_us"), "moved_us", "id", 0.15).select("id", "in_tail")


FOLDS = {"f1": ([1, 2, 3, 4], [5, 6]), "f2": ([1, 2, 3, 4, 5, 6], [7, 8]), "f3": ([1, 2, 3, 4, 5, 6, 7, 8], [9, 10])}


@query("f04_expanding_folds", "WITH $TV " + " UNION ALL ".join(f"SELECT '{k}' AS fold, CASE WHEN month IN ({', '.join(map(str, p))}) THEN 'predict' ELSE 'train' END AS role, count(*) AS n, sum(y) AS sum_y FROM o WHERE month IN ({', '.join(map(str, t + p))}) GROUP BY 2" for k, (t, p) in FOLDS.items()))
def f04(spark, folder):
    """expanding folds as a union of filtered copies."""
    o = outs(spark, folder).withColumn("month", month_of("moved_us"))
    return split.expanding_folds(o, "month", FOLDS).groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sum_y"))


@query("f05_sorted_report", "WITH $MOVES SELECT entity, lane, count(*) AS n, max(y) AS max_y FROM outs GROUP BY ALL ORDER BY max_y DESC, entity, lane")
def f05(spark, folder):
    """multi-key ordering of a result table."""
    return outs(spark, folder).groupBy("entity", "lane").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("max_y")).orderBy(F.col("max_y").desc(), "entity", "lane")


@query("f08_seeded_sample", "WITH $MOVES SELECT id, entity, y FROM outs ORDER BY md5(id || ':11'), id LIMIT 500")
def f08(spark, folder):
    """F8: repeatable random sample of a given size."""
    return history.sample_rows(outs(spark, folder).select("id", "entity", "y"), "id", 500, 11)


@query("f10_distinct_counts", "WITH $MOVES SELECT phase, count(DISTINCT entity) AS entities, count(DISTINCT (entity, lane, slot)) AS places, count(DISTINCT carrier) AS carriers FROM moves GROUP BY phase")
def f10(spark, folder):
    """distinct counts of a column and of tuples."""
    return moves(spark, folder).groupBy("phase").agg(F.countDistinct("entity").alias("entities"), F.countDistinct("entity", "lane", "slot").alias("places"), F.countDistinct("carrier").alias("carriers"))


SHIFT_SQL = lambda c: f"SELECT '{c}' AS \"column\", count(*) AS \"values\", count(*) FILTER (WHERE k NOT IN (SELECT {c} FROM tr0)) AS unseen_values, round(coalesce(sum(n) FILTER (WHERE k NOT IN (SELECT {c} FROM tr0)), 0) / (SELECT count(*) FROM va0), 6) AS unseen_row_share FROM (SELECT {c} AS k, count(*) AS n FROM va0 GROUP BY 1)"


@query("f11_domain_shift", "WITH $TV, x AS (SELECT *, entity * 100000 + slot * 1000 + carrier AS combo FROM o), tr0 AS (SELECT * FROM x WHERE month NOT IN (1, 7)), va0 AS (SELECT * FROM x WHERE month IN (1, 7)) " + " UNION ALL ".join(SHIFT_SQL(c) for c in ("combo", "slot")))
def f11(spark, folder):
    """values and rows of validation that training has not seen."""
    combo = F.col("entity") * 100000 + F.col("slot") * 1000 + F.col("carrier")
    tr, va = (d.withColumn("combo", combo) for d in train_val(spark, folder))
    got = split.domain_shift(tr, va, ["combo", "slot"])
    return got.withColumn("unseen_row_share", F.round("unseen_row_share", 6))


@query("f12_row_sequence", "WITH $MOVES SELECT id, row_number() OVER (PARTITION BY entity ORDER BY moved_us, id) AS seq FROM ins")
def f12(spark, folder):
    """row numbers within a group, computed per time slice."""
    from eventloom.operators.slices import slice_width, time_slice, with_position
    from eventloom.plans.tables import ins

    i = ins(spark, folder).select("id", "entity", "moved_us")
    cut = i.withColumn("_s", time_slice(F.col("moved_us"), slice_width([(i, "moved_us")])))
    return with_position(cut, ["entity"], ["moved_us", "id"], "_s", "seq").select("id", "seq")


@query("s01_s02_guarded_scan", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, max(epoch_us(o_orderdate)) AS last_us FROM orders GROUP BY o_orderstatus")
def s01(spark, folder):
    """A column-pruned scan over a checked list of files."""
    o = read_guarded(spark, [f"{folder}/orders.parquet"], ["o_orderkey", "o_orderstatus", "o_orderdate"], "orders")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"), F.max(epoch_us("o_orderdate")).alias("last_us"))


@query("s03_phase_streams", """WITH $MOVES SELECT phase, CASE WHEN phase = 'OUT' THEN entity ELSE slot % 10 END AS place, count(*) AS n FROM moves GROUP BY ALL""")
def s03(spark, folder):
    """S3: two streams of one table, each with the entity it belongs to."""
    m = moves(spark, folder).withColumn("destination", F.col("slot") % 10)
    out, inc = split_by_phase(m, "phase", "OUT", "entity", "destination", "place")
    return out.unionByName(inc).groupBy("phase", "place").agg(F.count(F.lit(1)).alias("n"))


@query("s05_keep_last", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) = 1")
def s05(spark, folder):
    """Of rows with the same key the last one stays."""
    li = read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate"])
    return keep_last(li, ["l_orderkey"], F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_quantity")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("s06_drifting_union", """WITH u AS (SELECT doc_id, lang, NULL::BIGINT AS toxic FROM documents UNION ALL SELECT doc_id, NULL, toxic FROM labels)
SELECT lang, toxic, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM u GROUP BY lang, toxic""")
def s06(spark, folder):
    """Files whose columns differ, as one table with typed nulls."""
    u = read_drifting(spark, [f"{folder}/documents.parquet", f"{folder}/labels.parquet"], {"doc_id": "bigint", "lang": "string", "toxic": "bigint"})
    return u.groupBy("lang", "toxic").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("s07_attributes_filled", """WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey < 20)
SELECT l_orderkey, l_linenumber, l_suppkey, round(coalesce(s_acctbal, (SELECT avg(s_acctbal) FROM s)), 4) AS balance FROM lineitem LEFT JOIN s ON l_suppkey = s_suppkey""")
def s07(spark, folder):
    """Attributes of a reference table; entities it lacks take the mean."""
    s = read_table(spark, folder, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("balance"))
    li = read_table(spark, folder, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey"])
    return join_filled(li, s, ["l_suppkey"], ["balance"]).select("l_orderkey", "l_linenumber", "l_suppkey", F.round("balance", 4).alias("balance"))


@query("p17_code_flags", """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_type END AS c, p_size / 10.0 AS v, CASE WHEN p_size % 3 > 0 THEN p_size END AS s, CASE WHEN p_size % 4 > 0 THEN p_size - 30 END AS p FROM part)
SELECT p_partkey, coalesce(v < 1, false)::INT AS low_visibility, (coalesce(upper(c), '') LIKE '%FG%' OR coalesce(v < 0.5, false))::INT AS fog,
  (regexp_matches(coalesce(upper(c), ''), 'RA|SN|DZ|SH|TS|GR|PL|IC') OR coalesce(p > 0, false))::INT AS wet, coalesce(s >= 20, false)::INT AS strong_wind FROM r""")
def p17(spark, folder):
    """Flags from report codes and measures, with codes and measures missing in places."""
    p = read_table(spark, folder, "part", ["p_partkey", "p_type", "p_size"])
    some = lambda test, c: F.when(test, c)
    reports = p.select(
        "p_partkey", some(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("wxcodes"), (F.col("p_size") / 10).alias("vsby"),
        some(F.col("p_size") % 3 > 0, F.col("p_size")).alias("sknt"), some(F.col("p_size") % 4 > 0, F.col("p_size") - 30).alias("p01i"),
    )
    return decode(reports).select("p_partkey", "low_visibility", "fog", "wet", "strong_wind")
