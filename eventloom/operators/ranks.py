"""Exact order statistics without gathering a group in one task.

Values are counted per ``(key, value)``, those counts are summed per value slice, and only the slices
that hold a wanted rank are ordered. Results equal a full sort of every group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.clock import col
from eventloom.operators.slices import UNBOUNDED, Running, attach_row, running, value_slice, with_position


def value_counts(df: DataFrame, keys: list[str], value: Column | str, weight: Column | None = None) -> DataFrame:
    """Rows per (key, value) as ``_v``, ``_c`` and the value's slice ``_b``; null and NaN are left out."""
    v = col(value).cast("double")
    kept = df.select(*keys, v.alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"))
    kept = kept.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = kept.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c"))
    return counted.withColumn("_b", value_slice(F.col("_v")))


def at_ranks(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    ranks: Callable[[Column], dict[str, Column]],
    weight: Column | None = None,
    count_name: str | None = None,
) -> DataFrame:
    """Values at given 0-based ranks of each group; ``ranks`` maps the group size column to named ranks."""
    counts = value_counts(df, keys, value, weight)
    slices = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    key_window = Window.partitionBy(*keys)
    slices = slices.select(
        *keys,
        "_b",
        "_bc",
        F.coalesce(F.sum("_bc").over(key_window.orderBy("_b").rowsBetween(UNBOUNDED, -1)), F.lit(0)).alias("_start"),
        F.sum("_bc").over(key_window).alias("_n"),
    )
    wanted = ranks(F.col("_n"))
    names = list(wanted)
    asks = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("r")) for i, r in enumerate(wanted.values())])
    inside = F.filter(asks, lambda x: (x["r"] >= F.col("_start")) & (x["r"] < F.col("_start") + F.col("_bc")))
    targets = slices.withColumn("_asks", inside).where(F.size("_asks") > 0).drop("_bc")
    found = counts.join(targets, [*keys, "_b"])
    upto = F.col("_start") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v"))
    found = found.withColumn("_upto", upto)
    hits = F.filter("_asks", lambda x: (x["r"] >= F.col("_upto") - F.col("_c")) & (x["r"] < F.col("_upto")))
    rows = found.select(*keys, "_v", "_n", F.explode(hits).alias("_hit"))
    aggs = [F.max(F.when(F.col("_hit.i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)]
    if count_name:
        aggs.append(F.max("_n").alias(count_name))
    return rows.groupBy(*keys).agg(*aggs)


def quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column | str,
    probs: dict[str, float | tuple[float, str]],
    method: str = "linear",
    weight: Column | None = None,
    count_name: str | None = None,
) -> DataFrame:
    """Exact group quantiles, ``linear`` (interpolated) or ``nearest`` (rank rounded half up).

    ``probs`` maps names to a probability, or to a pair of probability and its own method.
    """
    asked = {n: p if isinstance(p, tuple) else (p, method) for n, p in probs.items()}

    def ranks(n: Column) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for name, (p, how) in asked.items():
            at = (n - 1) * F.lit(float(p))
            if how == "nearest":
                out[name] = F.floor(at + F.lit(0.5))
            else:
                out[f"_lo_{name}"] = F.floor(at)
                out[f"_hi_{name}"] = F.ceil(at)
        return out

    size = count_name or "_n"
    got = at_ranks(df, keys, value, ranks, weight, size)
    final = []
    for name, (p, how) in asked.items():
        if how == "nearest":
            final.append(F.col(name))
            continue
        at = (F.col(size) - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        final.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return got.select(*keys, *final, *([count_name] if count_name else []))


def median_table(df: DataFrame, keys: list[str], value: Column | str, name: str) -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def cumulative_counts(df: DataFrame, keys: list[str], value: Column | str) -> DataFrame:
    """Distinct values ``_v`` of each key with ``_less`` (rows below) and ``_c`` (rows equal)."""
    counts = value_counts(df, keys, value)
    return running(counts, keys, ["_v"], "_b", [Running("_less", "sum", F.col("_c"), -1)]).drop("_b")


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Append the average rank (ties share the mean of their ranks)."""
    ranks = cumulative_counts(df, keys, value).select(
        *keys, F.col("_v"), (F.col("_less") + (F.col("_c") + 1) / F.lit(2.0)).alias(name)
    )
    base = df.withColumn("_v", F.col(value).cast("double"))
    return base.join(ranks, [*keys, "_v"], "left").drop("_v")


def rank_in_reference(df: DataFrame, value: str, reference: DataFrame, ref_value: str, name: str) -> DataFrame:
    """Share of reference values strictly below each value.

    Distinct values of both sides share one sliced running count, so neither side is broadcast.
    """
    refs = value_counts(reference, [], ref_value).select("_v", "_c")
    asks = df.select(F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    both = refs.unionByName(asks.withColumn("_c", F.lit(0).cast("long"))).groupBy("_v").agg(F.sum("_c").alias("_c"))
    ranked = running(both.withColumn("_b", value_slice(F.col("_v"))), [], ["_v"], "_b", [Running("_less", "sum", F.col("_c"), -1)])
    total = refs.agg(F.sum("_c").alias("n")).scalar()
    table = ranked.select("_v", (F.col("_less") / total).alias(name))
    return df.withColumn("_v", F.col(value).cast("double")).join(table, ["_v"], "left").drop("_v")


def ranked(df: DataFrame, keys: list[str], value: str, tie: list[str], name: str = "position", descending: bool = False) -> DataFrame:
    """1-based position by value, ties broken by ``tie``; the whole order never meets in one task."""
    v = F.col(value).cast("double")
    base = df.withColumn("_v", -v if descending else v).withColumn("_b", value_slice(F.col("_v")))
    return with_position(base, keys, ["_v", *tie], "_b", name, spread_ties=True).drop("_v", "_b")


def even_bins(df: DataFrame, value: str, tie: list[str], bins: int, name: str = "bin") -> DataFrame:
    """1-based bins of equal size over one global order; the first bins take the remainder."""
    placed = ranked(df, [], value, tie, "_pos")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(n / F.lit(bins))
    extra = n - size * bins
    head = extra * (size + 1)
    at = F.col("_pos") - 1
    number = F.when(at < head, F.floor(at / (size + 1))).otherwise(extra + F.floor((at - head) / F.greatest(size, F.lit(1))))
    return placed.withColumn(name, (number + 1).cast("int")).drop("_pos")


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with the inner and outer edges of equal-frequency bins as the array ``edges``, duplicates dropped."""
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    row = quantiles(df, [], value, probs)
    return row.select(F.array_distinct(F.array(*[F.col(c) for c in probs])).alias("edges"))


def quantile_bin(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """0-based equal-frequency bin, intervals closed on the right, the lowest edge included."""
    edges = quantile_edges(df, value, bins).scalar()
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return df.withColumn("_edges", inner).withColumn(
        name,
        F.when(F.col(value).isNotNull(), F.size(F.filter("_edges", lambda e: e < F.col(value)))).cast("int"),
    ).drop("_edges")


def top_sums(
    df: DataFrame, value: str, sizes: Callable[[Column], dict[str, Column]], keys: list[str] | None = None
) -> DataFrame:
    """Sum of the k largest values for several k given as functions of the row count.

    The k-th largest value is an exact order statistic; everything above it is summed and the missing
    rows count with exactly that value, so no rows need to be sorted or gathered.
    """
    keys = keys or []
    n_of = sizes
    cut = at_ranks(
        df, keys, value, lambda n: {k: F.greatest(n - size, F.lit(0)) for k, size in n_of(n).items()}, count_name="_n"
    )
    names = list(n_of(F.col("_n")))
    sized = cut.select(*keys, *[F.col(k) for k in names], *[s.alias(f"_size_{k}") for k, s in n_of(F.col("_n")).items()])
    v = F.col(value)
    if keys:
        joined = df.join(sized, keys)
    else:
        joined = attach_row(df, sized)
    aggs = []
    for k in names:
        above = F.sum(F.when(v > F.col(k), v).otherwise(F.lit(0.0)))
        rows_above = F.sum(F.when(v > F.col(k), F.lit(1)).otherwise(F.lit(0)))
        aggs.append((above + (F.max(f"_size_{k}") - rows_above) * F.max(k)).alias(k))
    return joined.groupBy(*keys).agg(*aggs, F.sum(v).alias("total"), F.count(v).alias("n"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
