"""Scoring of predictions and tables of where the error sits. Every table is one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.rows import finite, ratio
from eventloom.operators.ranks import quantile_bin, quantiles, top_sums
from eventloom.operators.slices import attach_row


def with_errors(df: DataFrame, y: str, p: str) -> DataFrame:
    """Rows where both sides are finite, with ``r``, ``sq`` and ``ab``."""
    r = F.col(y) - F.col(p)
    return df.where(finite(y, p)).withColumn("r", r).withColumn("sq", r * r).withColumn("ab", F.abs(r))


def block(prefix: str, mask: Column | None = None) -> list[Column]:
    """n, RMSE and MAE of the rows under a mask, as aggregate columns over ``sq`` and ``ab``."""
    tail = f"_{prefix}" if prefix else ""
    sq, ab = (F.col("sq"), F.col("ab")) if mask is None else (F.when(mask, F.col("sq")), F.when(mask, F.col("ab")))
    return [F.count(sq).alias(f"n{tail}"), F.sqrt(F.avg(sq)).alias(f"rmse{tail}"), F.avg(ab).alias(f"mae{tail}")]


def metric_block(df: DataFrame, y: str, p: str, matched: str, entity: str, thresholds: dict[str, float]) -> DataFrame:
    """Overall and per-entity metrics in one grouping: all rows, matched, unmatched, above thresholds.

    The overall row has a null entity.
    """
    e = with_errors(df, y, p)
    aggs = block("") + block("matched", F.col(matched)) + block("unmatched", ~F.col(matched))
    for name, x in thresholds.items():
        aggs += block(name, F.col(y) > x)
    return e.rollup(entity).agg(*aggs)


def matched_block(df: DataFrame, y: str, p: str, matched: str) -> DataFrame:
    """Matched rows: RMSE, mean residual, RMSE and share of squared error above 30 and 60 minutes."""
    e = with_errors(df, y, p).where(F.col(matched))
    cells = block("") + [F.avg("r").alias("resid_mean")]
    for name, x in {"gt30": 1800.0, "gt60": 3600.0}.items():
        mask = F.col(y) > x
        cells += [F.sqrt(F.avg(F.when(mask, F.col("sq")))).alias(f"rmse_{name}"), ratio(F.sum(F.when(mask, F.col("sq"))), F.sum("sq")).alias(f"share_{name}")]
    return e.agg(*cells)


def threshold_shares(df: DataFrame, y: str, p: str, thresholds: list[float], tops: dict[str, float]) -> DataFrame:
    """Squared error above outcome thresholds and in the worst share of rows, exact at any size."""
    e = with_errors(df, y, p).select(y, "r", "sq", "ab")
    cells = [F.count("sq").alias("n"), F.sum("sq").alias("sse")]
    for x in thresholds:
        mask = F.col(y) > x
        name = f"gt{int(x)}s"
        cells += [
            F.count(F.when(mask, 1)).alias(f"n_{name}"), F.sqrt(F.avg(F.when(mask, F.col("sq")))).alias(f"rmse_{name}"),
            ratio(F.coalesce(F.sum(F.when(mask, F.col("sq"))), F.lit(0.0)), F.sum("sq")).alias(f"share_{name}"),
        ]
    worst = top_sums(e, "sq", lambda n: {k: F.greatest(F.floor(n * F.lit(s)), F.lit(1)) for k, s in tops.items()})
    worst = worst.select(*[ratio(F.col(k), F.col("total")).alias(k) for k in tops])
    return attach_row(e.agg(*cells), worst)


def tail_table(df: DataFrame, y: str, p: str, thresholds: list[float], percents: list[int]) -> DataFrame:
    """One row per slice: |r| or r above thresholds, and the worst percents of rows."""
    e = with_errors(df, y, p).select("r", "sq", "ab")
    slices = {f"abs_{int(t)}": F.col("ab") > t for t in thresholds} | {f"pos_{int(t)}": F.col("r") > t for t in thresholds}
    cells = [
        F.struct(
            F.lit(name).alias("slice"), F.count(F.when(m, 1)).alias("n"), F.sqrt(F.avg(F.when(m, F.col("sq")))).alias("rmse"),
            ratio(F.coalesce(F.sum(F.when(m, F.col("sq"))), F.lit(0.0)), F.sum("sq")).alias("sse_share"),
        ).alias(name)
        for name, m in slices.items()
    ]
    table = e.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    size = lambda n, pct: F.ceil(n * F.lit(pct) / F.lit(100)).cast("long")
    worst = top_sums(e, "sq", lambda n: {f"top{k}pct": size(n, k) for k in percents})
    rows = [
        F.struct(
            F.lit(f"top{k}pct").alias("slice"), size(F.col("n"), k).alias("n"), F.sqrt(F.col(f"top{k}pct") / size(F.col("n"), k)).alias("rmse"),
            (F.col(f"top{k}pct") / F.col("total")).alias("sse_share"),
        )
        for k in percents
    ]
    return table.unionByName(worst.select(F.inline(F.array(*rows))))


def group_table(df: DataFrame, keys: list[str], y: str, p: str, min_n: int = 1) -> DataFrame:
    """Residual statistics per group with its share of all squared error."""
    e = with_errors(df, y, p)
    total = e.agg(F.sum("sq")).scalar()
    plain = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_y"), F.avg(p).alias("mean_pred"), F.avg("r").alias("mean_resid"),
        F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("std_resid"), F.avg("ab").alias("mae"), F.sqrt(F.avg("sq")).alias("rmse"), F.sum("sq").alias("sse"),
    )
    med = quantiles(e, keys, "r", {"median_resid": 0.5})
    p95 = quantiles(e, keys, "ab", {"p95_abs": 0.95})
    return plain.where(F.col("n") >= min_n).join(med, keys).join(p95, keys).withColumn("sse_share", ratio(F.col("sse"), total))


def worst_groups(df: DataFrame, keys: list[str], y: str, p: str, min_n: int, top: int) -> DataFrame:
    """The groups with the most squared error."""
    return group_table(df, keys, y, p, min_n).orderBy(F.col("sse").desc(), *keys).limit(top)


def banded(df: DataFrame, y: str, p: str, bands: dict[str, Column]) -> DataFrame:
    """n, RMSE, MAE, mean residual and share of squared error per band of each banding column."""
    e = with_errors(df, y, p)
    total = e.agg(F.sum("sq")).scalar()
    out = None
    for name, band in bands.items():
        g = e.groupBy(band.alias("band")).agg(*block(""), F.avg("r").alias("mean_resid"), (F.sum("sq") / F.max(total)).alias("sse_share"))
        g = g.select(F.lit(name).alias("by"), "*")
        out = g if out is None else out.unionByName(g)
    return out


def two_way(df: DataFrame, a: str, b: str, bins: int, y: str, p: str) -> DataFrame:
    """Residual statistics over quantile bins of two columns."""
    e = with_errors(df, y, p)
    binned = quantile_bin(quantile_bin(e, a, bins, "bin_a"), b, bins, "bin_b").where(F.col("bin_a").isNotNull() & F.col("bin_b").isNotNull())
    return binned.groupBy("bin_a", "bin_b").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_resid"), F.sqrt(F.avg("sq")).alias("rmse"))


def contrast(table: DataFrame, bins: int) -> DataFrame:
    """Per bin of a: mean residual in the highest bin of b minus that in the lowest."""
    wide = table.groupBy("bin_a").pivot("bin_b", list(range(bins))).agg(F.first("mean_resid"))
    return wide.withColumn("high_minus_low", F.col(str(bins - 1)) - F.col("0"))


def budget(df: DataFrame, y: str, p: str, slices: dict[str, Column]) -> DataFrame:
    """Squared error by population slice and its share of the whole."""
    e = with_errors(df, y, p)
    cells = [
        F.struct(
            F.lit(n).alias("slice"), F.count(F.when(m, 1)).alias("n"), F.coalesce(F.sum(F.when(m, F.col("sq"))), F.lit(0.0)).alias("sse"),
            ratio(F.coalesce(F.sum(F.when(m, F.col("sq"))), F.lit(0.0)), F.sum("sq")).alias("sse_share"),
        )
        for n, m in slices.items()
    ]
    return e.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def replaced_rmse(df: DataFrame, y: str, old: str, new: str, mask: Column) -> DataFrame:
    """Overall RMSE before and after a slice's predictions are replaced, from one pass."""
    both = df.where(finite(y, old))
    before = F.pow(F.col(y) - F.col(old), 2)
    after = F.when(mask & finite(new), F.pow(F.col(y) - F.col(new), 2)).otherwise(before)
    return both.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(before)).alias("rmse_old"), F.sqrt(F.avg(after)).alias("rmse_new"))


def concentration(df: DataFrame, y: str, p: str, counts: list[int], shares: dict[str, int]) -> DataFrame:
    """Share of squared error in the worst k rows, k given as a number or as one n-th of the rows."""
    e = with_errors(df, y, p).select("sq")

    def sizes(n: Column) -> dict[str, Column]:
        fixed = {f"worst_{k}": F.least(F.lit(k).cast("long"), n) for k in counts}
        parts = {name: F.greatest(F.floor(n / F.lit(part)).cast("long"), F.lit(1).cast("long")) for name, part in shares.items()}
        return fixed | parts

    got = top_sums(e, "sq", sizes)
    named = sizes(F.col("n"))
    return got.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("slice"), named[k].alias("k"), ratio(F.col(k), F.col("total")).alias("sse_share")) for k in named
    ])))


def residual_summary(df: DataFrame, y: str, p: str, limits: dict[str, float]) -> DataFrame:
    """Moments (skewness adjusted for bias), quantiles and shares of a residual."""
    e = with_errors(df, y, p)
    n = F.count("r").cast("double")
    adjust = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    plain = e.agg(
        *block(""), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), (F.skewness("r") * adjust).alias("skew"),
        F.min("r").alias("min"), F.max("r").alias("max"), F.avg((F.col("r") < 0).cast("double")).alias("share_negative"),
        *[F.avg((F.col("ab") > x).cast("double")).alias(f"share_{k}") for k, x in limits.items()],
        F.corr(y, p).alias("corr"),
    )
    qs = quantiles(e, [], "r", {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    return attach_row(plain, qs)


def top_composition(df: DataFrame, y: str, p: str, tie: str, k: int, by: str) -> DataFrame:
    """What the k worst rows are made of."""
    worst = with_errors(df, y, p).select(tie, by, "sq").orderBy(F.col("sq").desc(), tie).limit(k)
    return worst.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.lit(k)).alias("share"), F.sum("sq").alias("sse"))


def by_population(df: DataFrame, entity: str, matched: str, y: str, p: str) -> DataFrame:
    """Matched and unmatched columns per entity with ratios and the entity's share of all squared error."""
    e = with_errors(df, y, p)
    total = e.agg(F.sum("sq")).scalar()
    got = e.groupBy(entity).agg(*block("matched", F.col(matched)), *block("unmatched", ~F.col(matched)), F.sum("sq").alias("_sse"))
    return got.select(
        "*",
        (F.col("n_unmatched") / (F.col("n_matched") + F.col("n_unmatched"))).alias("unmatched_share"),
        ratio(F.col("rmse_unmatched"), F.col("rmse_matched")).alias("rmse_ratio"),
        (F.col("_sse") / total).alias("sse_share"),
    ).drop("_sse")


def gate_report(df: DataFrame, gates: dict[str, Column], label: Column) -> DataFrame:
    """Precision and recall of several gates against a label, in one pass."""
    hit = F.coalesce(label, F.lit(False))
    cells = []
    for name, g in gates.items():
        tp, fp, fn = F.count(F.when(g & hit, 1)), F.count(F.when(g & ~hit, 1)), F.count(F.when(~g & hit, 1))
        cells.append(F.struct(
            F.lit(name).alias("gate"), (tp + fp).alias("n_gate"), (tp + fn).alias("n_label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
            ratio(tp.cast("double"), tp + fp).alias("precision"), ratio(tp.cast("double"), tp + fn).alias("recall"),
        ))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def league(df: DataFrame, y: str, predictors: dict[str, Column]) -> DataFrame:
    """RMSE and MAE of many predictors over one scan, each on its own finite rows."""
    cells = []
    for name, p in predictors.items():
        ok = finite(F.col(y)) & finite(p)
        r = F.when(ok, F.col(y) - p)
        cells.append(F.struct(F.lit(name).alias("predictor"), F.count(r).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def verdict(scores: DataFrame, base: str, accept: tuple[float, float], weak: tuple[float, float]) -> DataFrame:
    """Best candidate on the first split against the base, judged on both splits.

    ``scores`` has candidate, first, second (RMSE). The candidate table is a handful of rows.
    """
    b = scores.where(F.col("candidate") == base).select(F.struct("first", "second")).scalar()
    others = scores.where(F.col("candidate") != base)
    best = others.agg(F.min_by(F.struct("candidate", "first", "second"), F.struct("first", "candidate")).alias("best"))
    gain, loss = b["first"] - F.col("best.first"), F.col("best.second") - b["second"]
    call = (
        F.when(gain <= 0, "REJECT")
        .when((gain >= accept[0]) & (loss <= accept[1]), "ACCEPT")
        .when((gain >= weak[0]) & (loss <= weak[1]), "WEAK")
        .otherwise("REJECT")
    )
    return best.select(F.col("best.candidate").alias("best"), gain.alias("gain_first"), (-loss).alias("gain_second"), call.alias("verdict"))


def quantile_compression(df: DataFrame, y: str, p: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles of outcome and prediction beside each other."""
    a = quantiles(df, [], y, {f"y_{k}": q for k, q in probs.items()})
    b = quantiles(df, [], p, {f"p_{k}": q for k, q in probs.items()})
    both = attach_row(a, b)
    return both.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("quantile"), F.col(f"y_{k}").alias("true"), F.col(f"p_{k}").alias("predicted"), ratio(F.col(f"p_{k}"), F.col(f"y_{k}")).alias("ratio"))
        for k in probs
    ])))

