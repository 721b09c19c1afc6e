"""Group statistics and leakage-safe encodings of an outcome by key.

Fitted tables stay DataFrames and are applied with left joins; whether one is broadcast is Spark's
decision by its size. Missing groups fall back to a coarser key, then to the whole table.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.rows import clip
from eventloom.operators.ranks import quantiles, value_counts


def group_stats(df: DataFrame, keys: list[str], y: str) -> DataFrame:
    """n, mean, sample std, median and nearest p25 / p75 / p90 of each group."""
    plain = df.groupBy(*keys).agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"))
    ranks = quantiles(df, keys, y, {"med": 0.5, "p25": (0.25, "nearest"), "p75": (0.75, "nearest"), "p90": (0.90, "nearest")})
    return plain.join(ranks, keys)


def group_stats_levels(df: DataFrame, levels: dict[str, list[str]], y: str) -> DataFrame:
    """:func:`group_stats` at several key levels in one pass, as with grouping sets.

    Every row is read once and repeated per level with the keys of that level only; ``level`` names it and
    keys that are not part of a level are null.
    """
    names = sorted({k for keys in levels.values() for k in keys})
    kinds = dict(df.dtypes)
    cells = [
        F.struct(F.lit(level).alias("level"), *[(F.col(k) if k in keys else F.lit(None).cast(kinds[k])).alias(k) for k in names])
        for level, keys in levels.items()
    ]
    spread = df.select(F.explode(F.array(*cells)).alias("key"), F.col(y))
    return group_stats(spread, ["key"], y).select("key.*", "n", "mean", "std", "med", "p25", "p75", "p90")


def prefixed(table: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return table.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in table.columns if c not in keys])


def attach_levels(df: DataFrame, tables: dict[str, tuple[list[str], DataFrame]]) -> DataFrame:
    """Left join several group tables, their columns prefixed by the level name."""
    for name, (keys, table) in tables.items():
        df = df.join(prefixed(table, keys, name), keys, "left")
    return df


def first_supported(levels: list[str], stat: str, min_n: int) -> Column:
    """The statistic of the first level with enough rows; the last level needs none."""
    picks = [F.when((F.col(f"{p}_n") >= min_n) & F.col(f"{p}_{stat}").isNotNull(), F.col(f"{p}_{stat}")) for p in levels[:-1]]
    return F.coalesce(*picks, F.col(f"{levels[-1]}_{stat}"))


def shrink(n: Column, value: Column, parent: Column, k: float) -> Column:
    """``(n * value + k * parent) / (n + k)``, the parent where the group is missing."""
    return F.when(n > 0, (n * value + F.lit(float(k)) * parent) / (n + F.lit(float(k)))).otherwise(parent)


def quantile_levels(df: DataFrame, levels: dict[str, list[str]], y: str, q: float, method: str) -> dict[str, tuple[list[str], DataFrame]]:
    return {name: (keys, quantiles(df, keys, y, {"q": q}, method, count_name="n")) for name, keys in levels.items()}


def shrunk_levels(levels: list[str], ks: list[float], stat: str = "q") -> Column:
    """Shrink the finest level towards the next coarser one, and so on; ``levels`` run from fine to coarse."""
    value = F.col(f"{levels[-1]}_{stat}")
    for name, k in zip(reversed(levels[:-1]), reversed(ks)):
        value = shrink(F.coalesce(F.col(f"{name}_n"), F.lit(0)), F.col(f"{name}_{stat}"), value, k)
    return value


def shrunk_floor(
    train: DataFrame, apply_to: DataFrame, levels: dict[str, list[str]], ks: list[float], y: str, q: float = 0.10
) -> DataFrame:
    """Hierarchical shrunk low quantile as a floor (at least 1) and the support of the finest level."""
    joined = attach_levels(apply_to, quantile_levels(train, levels, y, q, "nearest"))
    names = list(levels)
    return joined.select(
        *apply_to.columns,
        F.greatest(shrunk_levels(names, ks), F.lit(1.0)).alias("floor"),
        F.coalesce(F.col(f"{names[0]}_n"), F.lit(0)).cast("double").alias("floor_n"),
    )


def fold_map(counts: dict[int, int], least: int) -> dict[int, list[int]]:
    """For each period the target periods whose history it belongs to.

    A period's history is all earlier periods when they hold ``least`` rows, else all other periods.
    """
    targets: dict[int, list[int]] = {p: [] for p in counts}
    for target in counts:
        forward = sum(n for p, n in counts.items() if p < target) >= least
        for p in counts:
            if (p < target) if forward else (p != target):
                targets[p].append(target)
    return targets


def time_forward_floor(
    train: DataFrame, period: str, levels: dict[str, list[str]], ks: list[float], y: str, usable: Column, least: int = 500, q: float = 0.10
) -> DataFrame:
    """Floors of training rows from their period's history only.

    Rows are counted per (key, period, value) first; only those counts are repeated for the periods they
    serve, and one exact weighted quantile per (key, target period) follows. The period counts collected
    here are at most a dozen numbers.
    """
    counts = {r[period]: r["n"] for r in train.groupBy(period).agg(F.count(F.lit(1)).alias("n")).collect()}
    targets = fold_map(counts, least)
    serves = F.create_map(*chain.from_iterable((F.lit(p), F.array(*[F.lit(t) for t in ts]).cast("array<int>")) for p, ts in targets.items()))
    history = train.where(usable)
    tables = {}
    for name, keys in levels.items():
        grouped = value_counts(history, [*keys, period], y).withColumn("_target", F.explode(serves[F.col(period)]))
        table = quantiles(grouped.drop("_b", period), [*keys, "_target"], "_v", {"q": q}, "nearest", F.col("_c"), "n")
        tables[name] = ([*keys, period], table.withColumnRenamed("_target", period))
    joined = attach_levels(train, tables)
    names = list(levels)
    return joined.select(
        *train.columns,
        F.greatest(shrunk_levels(names, ks), F.lit(1.0)).alias("floor"),
        F.coalesce(F.col(f"{names[0]}_n"), F.lit(0)).cast("double").alias("floor_n"),
    )


def mean_encoding(train: DataFrame, apply_to: DataFrame, keys: list[str], prior_keys: list[str], y: str, k: float, name: str) -> DataFrame:
    """Mean of the outcome by key, shrunk towards the mean of the coarser key, with its support."""
    fine = train.groupBy(*keys).agg(F.count(y).alias("_n"), F.avg(y).alias("_mean"))
    prior = train.groupBy(*prior_keys).agg(F.avg(y).alias("_prior"))
    joined = apply_to.join(fine, keys, "left").join(prior, prior_keys, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return joined.select(*apply_to.columns, shrink(n, F.col("_mean"), F.col("_prior"), k).alias(f"enc_{name}"), n.cast("double").alias(f"enc_n_{name}"))


def leave_period_out(
    train: DataFrame, period: str, keys: list[str], prior_keys: list[str], y: str, usable: Column, k: float, name: str
) -> DataFrame:
    """Encode training rows from all other periods: totals minus the period's own share.

    Sums and counts per (key, period) give every leave-one-out mean by subtraction; nothing is refitted.
    """
    used = train.where(usable & F.col(y).isNotNull())

    def rest(ks: list[str], n: str, s: str) -> DataFrame:
        cells = used.groupBy(*ks, period).agg(F.count(y).alias("_cn"), F.sum(y).alias("_cs"))
        totals = cells.groupBy(*ks).agg(F.sum("_cn").alias("_tn"), F.sum("_cs").alias("_ts"))
        asked = train.select(*ks, period).distinct()
        joined = asked.join(totals, ks, "left").join(cells, [*ks, period], "left")
        return joined.select(
            *ks, period,
            (F.coalesce("_tn", F.lit(0)) - F.coalesce("_cn", F.lit(0))).alias(n),
            (F.coalesce("_ts", F.lit(0.0)) - F.coalesce("_cs", F.lit(0.0))).alias(s),
        )

    joined = train.join(rest(keys, "_n", "_s"), [*keys, period], "left").join(rest(prior_keys, "_pn", "_ps"), [*prior_keys, period], "left")
    prior = F.col("_ps") / F.nullif(F.col("_pn"), F.lit(0))
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    return joined.select(*train.columns, shrink(F.col("_n"), mean, prior, k).alias(f"enc_{name}"), F.col("_n").cast("double").alias(f"enc_n_{name}"))


def residual_prior(train: DataFrame, apply_to: DataFrame, keys: list[str], residual: str, lam: float, name: str) -> DataFrame:
    """Empirical-Bayes correction ``n / (n + lambda) * mean`` of a residual; 0 for unseen keys."""
    g = train.groupBy(*keys).agg(F.count(residual).alias("_n"), F.avg(residual).alias("_m"))
    g = g.select(*keys, (F.col("_n") / (F.col("_n") + F.lit(float(lam))) * F.col("_m")).alias(name))
    return apply_to.join(g, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def event_rate(train: DataFrame, apply_to: DataFrame, key: list[str], event: Column, k: float, p0: Column, name: str) -> DataFrame:
    """Smoothed rate of a flag by key, the base rate for unseen keys."""
    g = train.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.avg(F.when(event, 1.0).otherwise(0.0)).alias("_p"))
    joined = apply_to.join(g, key, "left")
    rate = (F.col("_n") * F.col("_p") + F.lit(float(k)) * p0) / (F.col("_n") + F.lit(float(k)))
    return joined.withColumn(name, F.coalesce(rate, p0)).drop("_n", "_p")


def mix(first: Column, second: Column, p: Column) -> Column:
    weight = clip(p, 0.0, 1.0)
    return (F.lit(1.0) - weight) * first + weight * second


def analogues(train: DataFrame, apply_to: DataFrame, key_levels: list[list[str]], residual: str, support: int = 5) -> DataFrame:
    """Residual mean of the finest level with enough analogues, with a confidence; 0 where there is none."""
    df = apply_to
    for i, keys in enumerate(key_levels):
        g = train.groupBy(*keys).agg(F.count(residual).alias("n"), F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("sd"))
        g = g.where(F.col("n") >= support).select(*keys, F.struct("n", "mean", "sd").alias(f"_l{i}"))
        df = df.join(g, keys, "left")
    best = F.coalesce(*[F.col(f"_l{i}") for i in range(len(key_levels))])
    confidence = best["n"] / (best["n"] + F.lit(2.0)) / (F.lit(1.0) + best["sd"] / F.lit(600.0))
    return df.select(
        *apply_to.columns, F.coalesce(best["mean"], F.lit(0.0)).alias("analogue"), F.coalesce(confidence, F.lit(0.0)).alias("confidence")
    )


def climatology(train: DataFrame, apply_to: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Train mean of a value by key with its row count (nulls counted), and each row's anomaly against it."""
    g = train.groupBy(*keys).agg(F.avg(value).alias(f"{name}_mean"), F.count(F.lit(1)).alias(f"{name}_n"))
    return apply_to.join(g, keys, "left").withColumn(f"{name}_anomaly", F.col(value) - F.col(f"{name}_mean"))
