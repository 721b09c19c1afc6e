"""Linear calibration on grouped moments, blends, weights and small parameter searches.

Fits read one aggregate of sums; what comes back to the driver or to a Python helper is one small matrix
per group, never the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.rows import finite
from eventloom.operators.ranks import quantiles
from eventloom.operators.slices import attach_row


def gram(xs: list[Column], y: Column, weight: Column | None = None) -> Column:
    """Aggregate: upper triangle of the cross products of (1, xs…, y) as an array."""
    terms = [F.lit(1.0), *xs, y]
    w = F.lit(1.0) if weight is None else weight
    return F.array(*[F.sum(w * a * b) for i, a in enumerate(terms) for b in terms[i:]])


def _unpack(flat: np.ndarray, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    return m + np.triu(m, 1).T


def _scaled_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of a symmetric system after scaling its diagonal to one."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    return np.linalg.lstsq(a / np.outer(d, d), b / d, rcond=None)[0] / d


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_gram(flat: pd.Series) -> pd.Series:
    """Least-squares coefficients (intercept first) from packed cross products, one small system per row.

    The products are centred on the means before solving, which keeps the system well conditioned.
    """

    def one(values) -> list[float]:
        values = np.asarray(values, dtype=float)
        size = int((np.sqrt(8 * values.size + 1) - 1) / 2)
        m = _unpack(values, size)
        means = m[0, 1:] / m[0, 0]
        centred = m[1:, 1:] - m[0, 0] * np.outer(means, means)
        b = _scaled_solve(centred[:-1, :-1], centred[:-1, -1])
        return [float(means[-1] - b @ means[:-1]), *b.tolist()]

    return flat.map(one)


def linear(coefs: Column, xs: list[Column]) -> Column:
    out = F.element_at(coefs, 1)
    for i, x in enumerate(xs):
        out = out + F.element_at(coefs, i + 2) * x
    return out


def ols(train: DataFrame, apply_to: DataFrame, xs: list[str], y: str, name: str) -> DataFrame:
    """Ordinary least squares with intercept over complete rows; null where an input is missing."""
    cols = [F.col(x).cast("double") for x in xs]
    row = train.where(finite(*xs, y)).agg(gram(cols, F.col(y).cast("double")).alias("_g")).select(solve_gram("_g").alias("_w"))
    return attach_row(apply_to, row).withColumn(name, linear(F.col("_w"), cols)).drop("_w")


def group_ols(train: DataFrame, apply_to: DataFrame, keys: list[str], xs: list[str], y: str, min_n: int, name: str) -> DataFrame:
    """Least squares per group with at least ``min_n`` complete rows, the global fit for the others."""
    cols = [F.col(x).cast("double") for x in xs]
    rows = train.where(finite(*xs, y))
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), gram(cols, F.col(y).cast("double")).alias("_g"))
    per = per.where(F.col("_n") >= min_n).select(*keys, solve_gram("_g").alias("_wg"))
    whole = rows.agg(gram(cols, F.col(y).cast("double")).alias("_g")).select(solve_gram("_g").alias("_wa"))
    got = attach_row(apply_to.join(per, keys, "left"), whole)
    return got.withColumn(name, linear(F.coalesce("_wg", "_wa"), cols)).drop("_wg", "_wa")


def shrunk_group_line(
    train: DataFrame, apply_to: DataFrame, keys: list[str], x: str, y: str, parent: str, min_n: int, k: float, name: str
) -> DataFrame:
    """One-variable line per group mixed with a parent prediction by ``n / (n + k)``."""
    g = train.where(finite(x, y)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("_b"), F.regr_intercept(y, x).alias("_a"), F.stddev_pop(x).alias("_sd")
    ).where((F.col("_n") >= min_n) & (F.col("_sd") > 1e-6))
    got = apply_to.join(g, keys, "left")
    w = F.coalesce(F.col("_n") / (F.col("_n") + F.lit(float(k))), F.lit(0.0))
    line = F.coalesce(F.col("_a") + F.col("_b") * F.col(x), F.lit(0.0))
    mixed = w * line + (F.lit(1.0) - w) * F.col(parent)
    return got.withColumn(name, F.when(finite(x), mixed)).drop("_n", "_a", "_b", "_sd")


def group_bias(train: DataFrame, apply_to: DataFrame, keys: list[str], y: str, p: str, name: str) -> DataFrame:
    """Prediction plus the training group's mean residual (none for unseen groups)."""
    g = train.groupBy(*keys).agg(F.avg(F.col(y) - F.col(p)).alias("_bias"))
    return apply_to.join(g, keys, "left").withColumn(name, F.col(p) + F.coalesce("_bias", F.lit(0.0))).drop("_bias")


def _nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The w >= 0 that minimises w'aw - 2b'w, by active sets."""
    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a, b = a / np.outer(d, d), b / d
    w, active = np.zeros(len(b)), np.zeros(len(b), bool)
    least = 1e-10 * max(float(np.abs(b).max()), 1e-300)
    for _ in range(10 * len(b)):
        gain = np.where(active, -np.inf, b - a @ w)
        if gain.max() <= least:
            break
        active[gain.argmax()] = True
        while active.any():
            aim = np.zeros(len(b))
            at = np.flatnonzero(active)
            aim[at] = np.linalg.lstsq(a[np.ix_(at, at)], b[at], rcond=None)[0]
            low = active & (aim <= 0)
            if not low.any():
                w = aim
                break
            step = (w[low] / np.maximum(w[low] - aim[low], 1e-300)).min()
            w = w + step * (aim - w)
            active &= w > 1e-14
            w[~active] = 0.0
    return w / d


def nonnegative_weights(df: DataFrame, experts: list[str], y: str) -> dict[str, float]:
    """Non-negative least-squares weights of experts, scaled to sum to one.

    Spark sums the cross products (one number for each pair of experts); an active set is then solved on them: the expert that lowers
    the error most joins, and those that its solution would turn negative leave on the way there.
    """
    terms = [F.col(c).cast("double") for c in experts] + [F.col(y).cast("double")]
    flat = df.where(finite(*experts, y)).agg(F.array(*[F.sum(a * b) for i, a in enumerate(terms) for b in terms[i:]]).alias("g")).first()["g"]
    if flat[0] is None:  # no usable row
        return dict.fromkeys(experts, 0.0)
    m = _unpack(np.asarray(flat, dtype=float), len(terms))
    best = _nonnegative(m[:-1, :-1], m[:-1, -1])
    total = best.sum()
    return {c: float(x / total) if total > 0 else 0.0 for c, x in zip(experts, best)}


def blend(weights: dict[str, float]) -> Column:
    """Weighted sum of experts, null where one of them is missing."""
    out = None
    for c, w in weights.items():
        term = F.lit(float(w)) * F.col(c)
        out = term if out is None else out + term
    return out


def mean_of(columns: list[str]) -> Column:
    """Plain average, e.g. of predictions from several seeds."""
    return blend({c: 1.0 / len(columns) for c in columns})


def gated_blend(base: Column, corrected: Column, high: Column | float, jump: float, lam: float) -> Column:
    """Move towards a corrected value only where the base is high or the correction is large."""
    top = high if isinstance(high, Column) else F.lit(float(high))
    step = corrected - base
    return base + F.lit(float(lam)) * step * F.when((base > top) | (step > F.lit(float(jump))), 1.0).otherwise(0.0)


def decomposition(y: Column, d: Column) -> dict[str, Column]:
    """Targets T = y, G = d - y, and the shares R = G / d and Q = y / d kept inside [0, 1] (d at least 60)."""
    base = F.greatest(d, F.lit(60.0))
    share = lambda x: F.least(F.greatest(x / base, F.lit(0.0)), F.lit(1.0))
    return {"T": y, "G": d - y, "R": share(d - y), "Q": share(y)}


def recompose(kind: str, value: Column, d: Column) -> Column:
    """The outcome from a predicted target of :func:`decomposition`."""
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return {"T": value, "G": d - value, "R": d * (F.lit(1.0) - inside), "Q": d * inside}[kind]


def grid_scores(df: DataFrame, y: str, candidates: dict[str, Column]) -> DataFrame:
    """Squared error of every candidate of a parameter grid, from one aggregate over one scan."""
    cells = []
    for name, p in candidates.items():
        r = F.when(finite(y) & finite(p), F.col(y) - p)
        cells.append(F.struct(F.lit(name).alias("candidate"), F.count(r).alias("n"), F.sum(r * r).alias("sse")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def threshold_rule(df: DataFrame, x: str, y: str, rule: str, other: str, probs: list[float], gain: float = 1.0) -> DataFrame:
    """Best one-threshold rule: use ``rule`` where x is above (gt) or below (lt) a quantile of x, else ``other``.

    One pass scores all thresholds in both directions; the rule is kept only if it beats always using
    ``rule`` by ``gain``.
    """
    kept = df.where(finite(x, y, rule, other))
    names = [f"q{i}" for i in range(len(probs))]
    cuts = quantiles(kept, [], x, dict(zip(names, probs)))
    marked = attach_row(kept, cuts)
    err = lambda c: F.pow(F.col(y) - c, 2)
    cells = []
    for n in names:
        for side, use in (("gt", F.col(x) > F.col(n)), ("lt", F.col(x) < F.col(n))):
            chosen = F.when(use, F.col(rule)).otherwise(F.col(other))
            cells.append(F.struct(F.sqrt(F.avg(err(chosen))).alias("rmse"), F.lit(side).alias("side"), F.max(n).alias("threshold"), F.count_if(use).alias("n_rule")))
    row = marked.agg(F.array(*cells).alias("cells"), F.sqrt(F.avg(err(F.col(rule)))).alias("always"))
    best = row.select("always", F.array_min("cells").alias("b"))
    good = F.col("b.rmse") < F.col("always") - F.lit(float(gain))
    return best.select(
        F.when(good, F.col("b.threshold")).alias("threshold"), F.when(good, F.col("b.side")).otherwise(F.lit("gt")).alias("side"),
        F.when(good, F.col("b.rmse")).otherwise(F.col("always")).alias("rmse"), "always", F.when(good, F.col("b.n_rule")).alias("n_rule"),
    )


def hard_weights(df: DataFrame, residual: str, share: float, factor: float, name: str = "weight") -> DataFrame:
    """``|r| + 1``, times ``factor`` for rows beyond the given quantile of |r|."""
    sized = df.withColumn("_ab", F.abs(residual))
    cut = quantiles(sized, [], "_ab", {"_cut": share})
    marked = attach_row(sized, cut)
    w = F.col("_ab") + 1
    return marked.withColumn(name, F.when(F.col("_ab") > F.col("_cut"), w * F.lit(float(factor))).otherwise(w)).drop("_ab", "_cut")


def inverse_odds(df: DataFrame, probability: str, cap: float, name: str = "weight") -> DataFrame:
    """``(1 - p) / p`` with p kept inside [0.001, 0.999], capped at a quantile of itself."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-3)), F.lit(1 - 1e-3))
    raw = df.withColumn("_w", (F.lit(1.0) - p) / p)
    return attach_row(raw, quantiles(raw, [], "_w", {"_cap": cap})).withColumn(name, F.least("_w", "_cap")).drop("_w", "_cap")
