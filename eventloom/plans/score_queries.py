"""Scoring and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.clock import seconds_between
from eventloom.functions.rows import clip, gate, ladder
from eventloom.operators import history, ranks, robust, score
from eventloom.plans.encode_queries import train_val
from eventloom.plans.registry import query
from eventloom.plans.tables import CTES, outs, ticks

CTES["ERR"] = (
    CTES["TV"]
    + """,
e AS (SELECT *, y - late AS r, (y - late) * (y - late) AS sq, abs(y - late) AS ab FROM o)"""
)


def scored(spark, folder):
    """Outcome with the lateness as a simple predictor and the own duration as a second one."""
    tr, va = train_val(spark, folder)
    return tr.unionByName(va)


def rounded(df, skip=(), digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def sql_block(tail: str = "", cond: str = "") -> str:
    f = f" FILTER (WHERE {cond})" if cond else ""
    t = f"_{tail}" if tail else ""
    return f"count(sq){f} AS n{t}, round(sqrt(avg(sq){f}), 4) AS rmse{t}, round(avg(ab){f}, 4) AS mae{t}"


@query(
    "d01_d02_metric_block",
    f"""WITH $ERR SELECT entity, {sql_block()}, {sql_block('matched', 'matched')}, {sql_block('unmatched', 'NOT matched')}, {sql_block('gt12h', 'y > 43200')}, {sql_block('gt24h', 'y > 86400')}
FROM e GROUP BY ROLLUP (entity)""",
)
def d01(spark, folder):
    """RMSE, MAE and n overall, per entity, matched, unmatched and above thresholds."""
    return rounded(score.metric_block(scored(spark, folder), "y", "late", "matched", "entity", {"gt12h": 43200.0, "gt24h": 86400.0}))


@query(
    "d03_matched_block",
    f"""WITH $ERR SELECT {sql_block()}, round(avg(r), 4) AS resid_mean, round(sqrt(avg(sq) FILTER (WHERE y > 1800)), 4) AS rmse_gt30, round(sum(sq) FILTER (WHERE y > 1800) / sum(sq), 4) AS share_gt30,
  round(sqrt(avg(sq) FILTER (WHERE y > 3600)), 4) AS rmse_gt60, round(sum(sq) FILTER (WHERE y > 3600) / sum(sq), 4) AS share_gt60 FROM e WHERE matched""",
)
def d03(spark, folder):
    """D3: matched rows with tail shares and mean residual."""
    return rounded(score.matched_block(scored(spark, folder), "y", "late", "matched"))


@query(
    "d04_f07_threshold_shares",
    """WITH $ERR, w AS (SELECT sq, row_number() OVER (ORDER BY sq DESC) AS k, count(*) OVER () AS n FROM e)
SELECT (SELECT count(*) FROM e) AS n, (SELECT sum(sq) FROM e) AS sse, """
    + ", ".join(
        f"(SELECT count(*) FROM e WHERE y > {t}) AS n_gt{t}s, (SELECT round(sqrt(avg(sq)), 4) FROM e WHERE y > {t}) AS rmse_gt{t}s, (SELECT round(coalesce(sum(sq) FILTER (WHERE y > {t}), 0) / sum(sq), 4) FROM e) AS share_gt{t}s"
        for t in (1800, 43200, 86400)
    )
    + """, (SELECT round(sum(sq) FILTER (WHERE k <= greatest(floor(n * 0.01), 1)) / sum(sq), 4) FROM w) AS top1,
  (SELECT round(sum(sq) FILTER (WHERE k <= greatest(floor(n * 0.05), 1)) / sum(sq), 4) FROM w) AS top5""",
)
def d04(spark, folder):
    """Squared-error shares above thresholds and in the worst 1 % and 5 % of rows."""
    got = score.threshold_shares(scored(spark, folder), "y", "late", [1800.0, 43200.0, 86400.0], {"top1": 0.01, "top5": 0.05})
    return rounded(got, skip=("sse",))


@query(
    "d05_tail_metrics",
    "WITH $ERR, w AS (SELECT sq, row_number() OVER (ORDER BY sq DESC) AS k, count(*) OVER () AS n FROM e) "
    + " UNION ALL ".join(
        f"SELECT '{s}_{t}' AS slice, count(*) FILTER (WHERE {c} > {t}) AS n, round(sqrt(avg(sq) FILTER (WHERE {c} > {t})), 4) AS rmse, round(coalesce(sum(sq) FILTER (WHERE {c} > {t}), 0) / sum(sq), 4) AS sse_share FROM e"
        for s, c in (("abs", "ab"), ("pos", "r")) for t in (600, 43200)
    )
    + "".join(
        f" UNION ALL SELECT 'top{k}pct', CAST(max(ceil(n * {k} / 100)) AS BIGINT), round(sqrt(sum(sq) FILTER (WHERE k <= ceil(n * {k} / 100)) / max(ceil(n * {k} / 100))), 4), round(sum(sq) FILTER (WHERE k <= ceil(n * {k} / 100)) / sum(sq), 4) FROM w"
        for k in (1, 5, 10)
    ),
)
def d05(spark, folder):
    """Tail metrics by residual thresholds and worst percents."""
    return rounded(score.tail_table(scored(spark, folder), "y", "late", [600.0, 43200.0], [1, 5, 10]))


GROUP_SQL = """count(*) AS n, round(avg(y), 4) AS mean_y, round(avg(late), 4) AS mean_pred, round(avg(r), 4) AS mean_resid, median(r) AS median_resid, round(coalesce(stddev_samp(r), 0), 3) AS std_resid,
  round(avg(ab), 4) AS mae, round(sqrt(avg(sq)), 4) AS rmse, round(quantile_cont(ab, 0.95), 4) AS p95_abs, sum(sq) AS sse, round(sum(sq) / (SELECT sum(sq) FROM e), 6) AS sse_share"""


def tidy(df):
    names = {"std_resid": 3, "sse_share": 6, "median_resid": None, "sse": None}
    return df.select(*[F.round(c, names.get(c, 4)).alias(c) if t == "double" and names.get(c, 4) is not None else F.col(c) for c, t in df.dtypes])


@query("d06_group_table", f"WITH $ERR SELECT entity, lane, {GROUP_SQL} FROM e GROUP BY entity, lane HAVING count(*) >= 20")
def d06(spark, folder):
    """Residual table per group with its share of squared error."""
    return tidy(score.group_table(scored(spark, folder), ["entity", "lane"], "y", "late", 20))


@query("d06b_worst_groups", f"WITH $ERR SELECT slot, {GROUP_SQL} FROM e GROUP BY slot HAVING count(*) >= 20 ORDER BY sse DESC, slot LIMIT 12")
def d06b(spark, folder):
    """The twelve groups with the most squared error."""
    return tidy(score.worst_groups(scored(spark, folder), ["slot"], "y", "late", 20, 12))


def band_sql(name: str, expr: str) -> str:
    return f"SELECT '{name}' AS by, CAST({expr} AS INT) AS band, {sql_block()}, round(avg(r), 4) AS mean_resid, round(sum(sq) / (SELECT sum(sq) FROM e), 6) AS sse_share FROM e GROUP BY 2"


def steps(c: str, edges) -> str:
    return " + ".join(f"({c} >= {x})::INT" for x in edges)


@query(
    "d07_d08_d25_banded_errors",
    "WITH $ERR "
    + " UNION ALL ".join([band_sql("outcome", steps("y", (1800, 43200, 86400))), band_sql("error", steps("ab", (60, 600, 3600, 43200))), band_sql("residual", steps("r", (-3600, 0, 3600)))]),
)
def d07(spark, folder):
    """Errors by bins of the outcome, of the error's size and of the residual."""
    got = score.banded(
        scored(spark, folder), "y", "late",
        {
            "outcome": ladder(F.col("y"), [1800.0, 43200.0, 86400.0]),
            "error": ladder(F.col("ab"), [60.0, 600.0, 3600.0, 43200.0]),
            "residual": ladder(F.col("r"), [-3600.0, 0.0, 3600.0]),
        },
    )
    return tidy(got)


EDGES = lambda c, n: ", ".join(f"quantile_cont({c}, {i / n}) AS {c}{i}" for i in range(1, n))
BIN = lambda c, n: "(" + " + ".join(f"({c} > q.{c}{i})::INT" for i in range(1, n)) + ")"
TWO = f"q AS (SELECT {EDGES('taken', 4)}, {EDGES('cents', 4)} FROM e), b AS (SELECT CAST({BIN('taken', 4)} AS INT) AS bin_a, CAST({BIN('cents', 4)} AS INT) AS bin_b, r, sq FROM e, q WHERE taken IS NOT NULL)"


@query("d09_two_way_bins", f"WITH $ERR, {TWO} SELECT bin_a, bin_b, count(*) AS n, round(avg(r), 4) AS mean_resid, round(sqrt(avg(sq)), 4) AS rmse FROM b GROUP BY 1, 2")
def d09(spark, folder):
    """Residuals over quantile bins of two columns."""
    o = outs(spark, folder).select("id", "cents", seconds_between("moved_us", "start_us").cast("double").alias("taken"), seconds_between("moved_us", "planned_us").cast("double").alias("late"), "y")
    return rounded(score.two_way(o, "taken", "cents", 4, "y", "late"))


@query(
    "d09b_two_way_contrast",
    f"""WITH $ERR, {TWO}, t AS (SELECT bin_a, bin_b, avg(r) m FROM b GROUP BY 1, 2)
SELECT bin_a, {", ".join(f'round(max(m) FILTER (WHERE bin_b = {i}), 4) AS b{i}' for i in range(4))}, round(max(m) FILTER (WHERE bin_b = 3) - max(m) FILTER (WHERE bin_b = 0), 4) AS high_minus_low FROM t GROUP BY bin_a""",
)
def d09b(spark, folder):
    """The two-way table as a pivot with the contrast of its outer columns."""
    o = outs(spark, folder).select("id", "cents", seconds_between("moved_us", "start_us").cast("double").alias("taken"), seconds_between("moved_us", "planned_us").cast("double").alias("late"), "y")
    wide = score.contrast(score.two_way(o, "taken", "cents", 4, "y", "late"), 4)
    return rounded(wide.select("bin_a", *[F.col(str(i)).alias(f"b{i}") for i in range(4)], "high_minus_low"))


@query(
    "d10_error_budget",
    "WITH $ERR " + " UNION ALL ".join(
        f"SELECT '{n}' AS slice, count(*) FILTER (WHERE {c}) AS n, coalesce(sum(sq) FILTER (WHERE {c}), 0) AS sse, round(coalesce(sum(sq) FILTER (WHERE {c}), 0) / sum(sq), 6) AS sse_share FROM e"
        for n, c in (("matched", "matched"), ("unmatched", "NOT matched"), ("entity_3", "entity = 3"), ("rest", "matched AND entity <> 3"))
    ),
)
def d10(spark, folder):
    """Budget of squared error by population."""
    m = F.col("matched")
    return tidy(score.budget(scored(spark, folder), "y", "late", {"matched": m, "unmatched": ~m, "entity_3": F.col("entity") == 3, "rest": m & (F.col("entity") != 3)}))


@query(
    "d10b_replaced_slice",
    """WITH $ERR SELECT count(*) AS n, round(sqrt(avg(sq)), 4) AS rmse_old, round(sqrt(avg(CASE WHEN entity = 3 AND taken IS NOT NULL THEN (y - taken) * (y - taken) ELSE sq END)), 4) AS rmse_new FROM e""",
)
def d10b(spark, folder):
    """Overall RMSE when one slice's predictions are replaced."""
    return rounded(score.replaced_rmse(scored(spark, folder), "y", "late", "taken", F.col("entity") == 3))


@query(
    "d11_concentration",
    "WITH $ERR, w AS (SELECT sq, row_number() OVER (ORDER BY sq DESC) AS k, count(*) OVER () AS n FROM e) "
    + " UNION ALL ".join(
        f"SELECT '{s}' AS slice, CAST(max({k}) AS BIGINT) AS k, round(sum(sq) FILTER (WHERE k <= {k}) / sum(sq), 6) AS sse_share FROM w"
        for s, k in (("worst_1", "1"), ("worst_10", "10"), ("worst_100", "100"), ("one_percent", "greatest(n // 100, 1)"), ("ten_percent", "greatest(n // 10, 1)"))
    ),
)
def d11(spark, folder):
    """Share of squared error in the worst k rows."""
    return tidy(score.concentration(scored(spark, folder), "y", "late", [1, 10, 100], {"one_percent": 100, "ten_percent": 10}))


@query(
    "d12_residual_summary",
    f"""WITH $ERR SELECT {sql_block()}, round(avg(r), 4) AS mean, round(stddev_pop(r), 3) AS std, round(skewness(r), 6) AS skew, min(r) AS min, max(r) AS max, round(avg((r < 0)::INT), 6) AS share_negative,
  round(avg((ab > 3600)::INT), 6) AS share_gt1h, round(corr(y, late), 6) AS corr, round(quantile_cont(r, 0.05), 4) AS p5, round(quantile_cont(r, 0.25), 4) AS p25, round(quantile_cont(r, 0.5), 4) AS p50,
  round(quantile_cont(r, 0.75), 4) AS p75, round(quantile_cont(r, 0.95), 4) AS p95 FROM e""",
)
def d12(spark, folder):
    """Residual summary with bias-adjusted skewness and quantiles."""
    got = score.residual_summary(scored(spark, folder), "y", "late", {"gt1h": 3600.0})
    digits = {"std": 3, "skew": 6, "share_negative": 6, "share_gt1h": 6, "corr": 6}
    return got.select(*[F.round(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query(
    "d13_top_composition",
    """WITH $ERR, w AS (SELECT * FROM e ORDER BY sq DESC, id LIMIT 200) SELECT lane, count(*) AS n, round(count(*) / 200.0::DOUBLE, 6) AS share, sum(sq) AS sse FROM w GROUP BY lane""",
)
def d13(spark, folder):
    """Composition of the 200 worst rows."""
    return score.top_composition(scored(spark, folder), "y", "late", "id", 200, "lane").withColumn("share", F.round("share", 6))


@query(
    "d14_matched_unmatched_table",
    f"""WITH $ERR SELECT entity, {sql_block('matched', 'matched')}, {sql_block('unmatched', 'NOT matched')}, round(count(*) FILTER (WHERE NOT matched) / count(*), 4) AS unmatched_share,
  round(sqrt(avg(sq) FILTER (WHERE NOT matched)) / sqrt(avg(sq) FILTER (WHERE matched)), 4) AS rmse_ratio, round(sum(sq) / (SELECT sum(sq) FROM e), 4) AS sse_share FROM e GROUP BY entity""",
)
def d14(spark, folder):
    """Matched against unmatched per entity."""
    return rounded(score.by_population(scored(spark, folder), "entity", "matched", "y", "late"))


@query(
    "d15_gate_report",
    "WITH $ERR, l AS (SELECT *, y - late > 43200 AND y > 86400 AS hit FROM e) " + " UNION ALL ".join(
        f"SELECT '{n}' AS gate, count(*) FILTER (WHERE {g}) AS n_gate, count(*) FILTER (WHERE hit) AS n_label, count(*) FILTER (WHERE {g} AND hit) AS tp, count(*) FILTER (WHERE {g} AND NOT hit) AS fp, count(*) FILTER (WHERE NOT ({g}) AND hit) AS fn, "
        f"round(count(*) FILTER (WHERE {g} AND hit) / count(*) FILTER (WHERE {g}), 6) AS precision, round(count(*) FILTER (WHERE {g} AND hit) / count(*) FILTER (WHERE hit), 6) AS recall FROM l"
        for n, g in (("unmatched_early", "NOT matched AND late < 20000"), ("entities", "entity IN (1, 2, 3) AND lane IN ('1', '2')"))
    ),
)
def d15(spark, folder):
    """Precision and recall of row gates built from plain specifications."""
    gates = {
        "unmatched_early": gate({"equals": {"matched": False}, "between": {"late": (None, 20000.0)}}),
        "entities": gate({"among": {"entity": [1, 2, 3]}, "prefix": {"lane": ["1", "2"]}}),
    }
    label = (F.col("y") - F.col("late") > 43200) & (F.col("y") > 86400)
    got = score.gate_report(scored(spark, folder), gates, label)
    return got.withColumn("precision", F.round("precision", 6)).withColumn("recall", F.round("recall", 6))


LEAGUE_SQL = lambda n, p: f"SELECT '{n}' AS predictor, count({p}) AS n, round(sqrt(avg((y - {p}) * (y - {p}))), 4) AS rmse, round(avg(abs(y - {p})), 4) AS mae FROM j"


@query(
    "d16_naive_league",
    """WITH $ERR, g AS (SELECT avg(y) m FROM tr), a AS (SELECT entity, avg(y) m FROM tr GROUP BY ALL), b AS (SELECT entity, slot, lane, avg(y) m FROM tr GROUP BY ALL), c AS (SELECT carrier, avg(y) m FROM tr GROUP BY ALL),
j AS (SELECT va.*, g.m AS p_all, a.m AS p_entity, coalesce(b.m, a.m) AS p_slot_lane, c.m AS p_carrier, least(greatest(va.late, 0), 100000) AS p_clipped FROM va JOIN g ON true LEFT JOIN a USING (entity) LEFT JOIN b USING (entity, slot, lane) LEFT JOIN c USING (carrier))
"""
    + " UNION ALL ".join(LEAGUE_SQL(n, c) for n, c in (("global mean", "p_all"), ("entity mean", "p_entity"), ("slot and lane mean", "p_slot_lane"), ("carrier mean", "p_carrier"), ("lateness", "late"), ("duration", "taken"), ("clipped lateness", "p_clipped"))),
)
def d16(spark, folder):
    """League of naive predictors fitted on training rows."""
    tr, va = train_val(spark, folder)
    mean = lambda keys, n: tr.groupBy(*keys).agg(F.avg("y").alias(n))
    got = va.join(mean(["entity"], "p_entity"), ["entity"], "left").join(mean(["entity", "slot", "lane"], "m"), ["entity", "slot", "lane"], "left").join(mean(["carrier"], "p_carrier"), ["carrier"], "left")
    got = robust.attach_row(got, tr.agg(F.avg("y").alias("p_all")))
    return rounded(score.league(got, "y", {
        "global mean": F.col("p_all"), "entity mean": F.col("p_entity"), "slot and lane mean": F.coalesce("m", "p_entity"), "carrier mean": F.col("p_carrier"),
        "lateness": F.col("late"), "duration": F.col("taken"), "clipped lateness": clip(F.col("late"), 0.0, 100000.0),
    }))


@query(
    "d18_prediction_distribution",
    """WITH $ERR SELECT entity, count(late) AS n, round(avg(late), 4) AS mean, median(late) AS med, round(stddev_samp(late), 3) AS std, round(quantile_cont(late, 0.05), 4) AS p5, round(quantile_cont(late, 0.95), 4) AS p95, round(quantile_cont(late, 0.99), 4) AS p99,
  round(avg((late > 86400)::INT), 6) AS share_gt1d FROM e GROUP BY entity""",
)
def d18(spark, folder):
    """Distribution of predictions per entity."""
    o = scored(spark, folder)
    g = o.groupBy("entity").agg(F.count("late").alias("n"), F.round(F.avg("late"), 4).alias("mean"), F.round(F.stddev_samp("late"), 3).alias("std"), F.round(F.avg((F.col("late") > 86400).cast("double")), 6).alias("share_gt1d"))
    q = ranks.quantiles(o, ["entity"], "late", {"med": 0.5, "p5": 0.05, "p95": 0.95, "p99": 0.99})
    return g.join(q, ["entity"]).select(*g.columns, "med", *[F.round(c, 4).alias(c) for c in ("p5", "p95", "p99")])


@query(
    "d19_verdict",
    """WITH $ERR, s AS (SELECT 'base' AS candidate, sqrt(avg((y - late) * (y - late)) FILTER (WHERE month = 1)) AS first, sqrt(avg((y - late) * (y - late)) FILTER (WHERE month = 7)) AS second FROM o
UNION ALL SELECT 'clipped', sqrt(avg(pow(y - least(greatest(late, 0), 150000), 2)) FILTER (WHERE month = 1)), sqrt(avg(pow(y - least(greatest(late, 0), 150000), 2)) FILTER (WHERE month = 7)) FROM o
UNION ALL SELECT 'halved', sqrt(avg(pow(y - 0.5::DOUBLE * late, 2)) FILTER (WHERE month = 1)), sqrt(avg(pow(y - 0.5::DOUBLE * late, 2)) FILTER (WHERE month = 7)) FROM o),
b AS (SELECT * FROM s WHERE candidate = 'base'), c AS (SELECT * FROM s WHERE candidate <> 'base' ORDER BY first, candidate LIMIT 1)
SELECT c.candidate AS best, round(b.first - c.first, 4) AS gain_first, round(b.second - c.second, 4) AS gain_second,
  CASE WHEN b.first - c.first <= 0 THEN 'REJECT' WHEN b.first - c.first >= 1.5 AND c.second - b.second <= 3 THEN 'ACCEPT' WHEN b.first - c.first >= 0.5 AND c.second - b.second <= 5 THEN 'WEAK' ELSE 'REJECT' END AS verdict FROM b, c""",
)
def d19(spark, folder):
    """Candidate against base, judged on two holdouts."""
    o = scored(spark, folder)
    p = {"base": F.col("late"), "clipped": clip(F.col("late"), 0.0, 150000.0), "halved": F.lit(0.5) * F.col("late")}
    first = score.league(o.where("month = 1"), "y", p).select(F.col("predictor").alias("candidate"), F.col("rmse").alias("first"))
    second = score.league(o.where("month = 7"), "y", p).select(F.col("predictor").alias("candidate"), F.col("rmse").alias("second"))
    return rounded(score.verdict(first.join(second, ["candidate"]), "base", (1.5, 3.0), (0.5, 5.0)))


@query(
    "d20_leakage_audit",
    """WITH $TICKS, c AS (SELECT id, count(*) OVER (PARTITION BY entity ORDER BY at_us, id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS n FROM ticks)
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS future, CAST(0 AS BIGINT) AS self, count(*) FILTER (WHERE n = 0) AS empty FROM c""",
)
def d20(spark, folder):
    """Audit of histories for future events and the row itself."""
    got = history.histories(ticks(spark, folder), ["entity"], ["at_us", "id"], 16, {"id": "id"}, "at_us")
    return history.leakage_audit(got, "at_us", "id", "id")


@query(
    "d21_extremes",
    """WITH $ERR SELECT entity, count(*) AS n, count(*) FILTER (WHERE y > 43200) AS n_gt12h, count(*) FILTER (WHERE y > 86400) AS n_gt24h, count(*) FILTER (WHERE late < 0) AS n_negative, max(y) AS max_y, round(sum(sq) FILTER (WHERE y > 86400) / sum(sq), 6) AS sse_share_gt24h FROM e GROUP BY entity""",
)
def d21(spark, folder):
    """Extreme and negative values by entity, with their share of squared error."""
    e = score.with_errors(scored(spark, folder), "y", "late")
    return e.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") > 43200).alias("n_gt12h"), F.count_if(F.col("y") > 86400).alias("n_gt24h"), F.count_if(F.col("late") < 0).alias("n_negative"),
        F.max("y").alias("max_y"), F.round(F.sum(F.when(F.col("y") > 86400, F.col("sq"))) / F.sum("sq"), 6).alias("sse_share_gt24h"),
    )


@query(
    "d23_quantile_compression",
    "WITH $ERR " + " UNION ALL ".join(f"SELECT 'q{int(q * 100)}' AS quantile, round(quantile_cont(y, {q}), 4) AS \"true\", round(quantile_cont(late, {q}), 4) AS predicted, round(quantile_cont(late, {q}) / quantile_cont(y, {q}), 6) AS ratio FROM e" for q in (0.5, 0.9, 0.95, 0.99)),
)
def d23(spark, folder):
    """Quantiles of outcome against those of the prediction."""
    got = score.quantile_compression(scored(spark, folder), "y", "late", {f"q{int(q * 100)}": q for q in (0.5, 0.9, 0.95, 0.99)})
    return got.select("quantile", F.round("true", 4).alias("true"), F.round("predicted", 4).alias("predicted"), F.round("ratio", 6).alias("ratio"))


@query(
    "d24_join_coverage",
    """WITH $ERR, j AS (SELECT o.*, i.y AS other FROM o LEFT JOIN (SELECT slot, lane, max(y) AS y FROM ins WHERE kind = 3 GROUP BY ALL) i USING (slot, lane))
SELECT count(*) AS n, count(other) AS joined, round(count(other) / count(*), 6) AS coverage, median(y - other) AS median_difference FROM j""",
)
def d24(spark, folder):
    """Coverage of a join and the median difference of what it joined."""
    from eventloom.plans.tables import ins

    i = ins(spark, folder).where("kind = 3").groupBy("slot", "lane").agg(F.max("y").alias("other"))
    j = scored(spark, folder).join(i, ["slot", "lane"], "left").withColumn("diff", F.col("y") - F.col("other"))
    one = j.agg(F.count(F.lit(1)).alias("n"), F.count("other").alias("joined"), F.round(F.count("other") / F.count(F.lit(1)), 6).alias("coverage"))
    return robust.attach_row(one, ranks.quantiles(j, [], "diff", {"median_difference": 0.5}))
