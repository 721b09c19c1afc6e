"""Robust scales, corrections, correlations, variance shares and stability indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.rows import clip, finite
from eventloom.operators.ranks import average_ranks, quantiles
from eventloom.operators.slices import attach_row


def winsorised_mean(df: DataFrame, keys: list[str], x: str, share: float = 0.05, name: str = "winsor") -> DataFrame:
    """Mean of a value clipped to its own lower and upper quantile, per group, with the group size."""
    bounds = quantiles(df, keys, x, {"_lo": share, "_hi": 1 - share})
    joined = df.join(bounds, keys) if keys else attach_row(df, bounds)
    clipped = F.when(finite(x), F.least(F.greatest(F.col(x), F.col("_lo")), F.col("_hi")))
    return joined.groupBy(*keys).agg(F.avg(clipped).alias(name), F.count(clipped).alias("n"))


def additive_correction(train: DataFrame, apply_to: DataFrame, by: list[str], residual: str, how: str, min_n: int, name: str) -> DataFrame:
    """Group correction (mean, median or winsor) where the group has ``min_n`` rows, else the global one."""

    def fit(keys: list[str]) -> DataFrame:
        if how == "mean":
            return train.groupBy(*keys).agg(F.avg(residual).alias("_c"), F.count(residual).alias("n"))
        if how == "median":
            return quantiles(train, keys, residual, {"_c": 0.5}, count_name="n")
        return winsorised_mean(train, keys, residual, name="_c")

    groups = fit(by).where(F.col("n") >= min_n).select(*by, "_c")
    whole = fit([]).select("_c").scalar()
    return apply_to.join(groups, by, "left").withColumn(name, F.coalesce(F.col("_c"), whole)).drop("_c")


def robust_scale(df: DataFrame, r: str) -> DataFrame:
    """Median, MAD, 1.4826·MAD and the Huber bound max(1.345·sigma, 1) of a residual."""
    med = quantiles(df, [], r, {"median": 0.5}, count_name="n")
    away = attach_row(df.select(r), med.select("median")).select(F.abs(F.col(r) - F.col("median")).alias("_d"))
    mad = quantiles(away, [], "_d", {"mad": 0.5})
    row = attach_row(med, mad)
    sigma = F.lit(1.4826) * F.col("mad")
    return row.select("n", "median", "mad", sigma.alias("sigma"), F.greatest(F.lit(1.345) * sigma, F.lit(1.0)).alias("delta"))


def positive_median(df: DataFrame, r: str, default: float = 1800.0) -> DataFrame:
    """Median of the positive residuals (``default`` when there are none)."""
    got = quantiles(df.where(F.col(r) > 0), [], r, {"scale": 0.5})
    return df.sparkSession.range(1).select(F.coalesce(got.scalar(), F.lit(default)).alias("scale"))


def smear_factor(z_true: Column, z_pred: Column, low: float = -2.5, high: float = 2.5) -> Column:
    """Aggregate expression: mean of exp(clipped residual) inside [1, 3]; 1 below ten rows."""
    r = clip(z_true - z_pred, low, high)
    return F.when(F.count(r) < 10, F.lit(1.0)).otherwise(clip(F.avg(F.exp(r)), 1.0, 3.0))


def safe_corr(a: Column, b: Column, min_n: int = 30) -> Column:
    """Pearson correlation over complete pairs; null below ``min_n`` pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    ok = (F.count(x) >= min_n) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(ok, F.corr(x, y))


def correlation_table(df: DataFrame, left: list[str], right: list[str], min_n: int = 30) -> DataFrame:
    """All correlations of two column lists in one aggregate, one row per pair."""
    cells = [safe_corr(F.col(a).cast("double"), F.col(b).cast("double"), min_n).alias(f"{a}|{b}") for a in left for b in right]
    row = df.agg(*cells)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a in left for b in right])
    return row.select(F.inline(pairs))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = average_ranks(average_ranks(both, [], "a", "ra"), [], "b", "rb")
    return ranked.agg(F.corr("ra", "rb").alias("spearman"), F.count(F.lit(1)).alias("n"))


def variance_share(df: DataFrame, factors: dict[str, list[str]], y: str) -> DataFrame:
    """Share of the variance of y between the groups of each factor (eta squared)."""
    out = None
    whole = df.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.count(y).alias("n"))
    for name, keys in factors.items():
        g = df.groupBy(*keys).agg(F.count(y).alias("_n"), F.avg(y).alias("_m"))
        one = attach_row(g, whole).agg(
            F.lit(name).alias("factor"), F.count(F.lit(1)).alias("groups"),
            (F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("m"), 2)) / F.nullif(F.max(F.col("v") * F.col("n")), F.lit(0.0))).alias("eta2"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def stability_index(a: DataFrame, b: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """Population stability index of b against a over equal-frequency bins of a.

    Edges are the inner quantiles of a; a bin is closed on the left, values are counted per bin on both
    sides, and only ``bins`` rows meet at the end.
    """
    probs = {f"e{i}": i / bins for i in range(1, bins)}
    edges = quantiles(a, [], x, probs).select(F.array(*probs).alias("edges"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        marked = attach_row(df.where(finite(x)).select(F.col(x).alias("_x")), edges)
        # the last edge closes the last bin on both sides, the others belong to the bin on their right
        at = F.size(F.filter("edges", lambda e: e <= F.col("_x")))
        return marked.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias(name))

    both = counts(a, "na").join(counts(b, "nb"), ["bin"], "full")
    wide = both.agg(
        F.sum("na").alias("ta"), F.sum("nb").alias("tb"),
        F.collect_list(F.struct(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))).alias("cells"),
    )
    pa = lambda c: c["na"] / F.col("ta") + F.lit(1e-6)
    pb = lambda c: c["nb"] / F.col("tb") + F.lit(1e-6)
    terms = F.transform("cells", lambda c: (pb(c) - pa(c)) * F.log(pb(c) / pa(c)))
    return wide.select(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("psi"))
