"""Profiling: nulls, schemas, ranges, identities, densities, gaps, multiplicity, enrichment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.clock import SECOND, truncate
from eventloom.functions.rows import ratio
from eventloom.operators.ranks import quantiles
from eventloom.operators.rowframes import over_rows
from eventloom.operators.slices import attach_row


def null_profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows and nulls per column (one row per column and group), all from one aggregate."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows")) for c in columns]
    return df.groupBy(*(by or [])).agg(F.array(*cells).alias("c")).select(*(by or []), F.inline("c"))


def null_overlap(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each pair of columns the rows where both are null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(F.col(a).isNull() & F.col(b).isNull()).alias("both_null")) for a, b in pairs]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in columns])


def schema_differences(frames: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """(table, column, type here, type in the first table) wherever a schema departs from the first one."""
    names = list(frames)
    base = dict(frames[names[0]].dtypes)
    out = []
    for name in names[1:]:
        kinds = dict(frames[name].dtypes)
        out += [(name, c, kinds.get(c, "missing"), base.get(c, "missing")) for c in sorted(set(base) | set(kinds)) if base.get(c) != kinds.get(c)]
    return out


def forbid_columns(df: DataFrame, parts: list[str]) -> DataFrame:
    """Return ``df`` unless a column name contains a forbidden part."""
    bad = [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]
    if bad:
        raise ValueError(f"columns that must not be used here: {bad}")
    return df


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.min(c).alias("low"), F.max(c).alias("high")) for c in columns]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column)).limit(k)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys that occur more than once, the rows they hold and the largest multiplicity."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"), F.max("n").alias("largest"))


def identity_audit(df: DataFrame, target: str, rebuilt: str) -> DataFrame:
    """How a target compares with a rebuilt value: exact share, signs, mean and quantiles of the distance."""
    d = df.where(F.col(target).isNotNull() & F.col(rebuilt).isNotNull()).select((F.col(target) - F.col(rebuilt)).alias("d"))
    d = d.withColumn("ad", F.abs("d"))
    plain = d.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("d") == 0).cast("double")).alias("exact"), F.count_if(F.col("d") > 0).alias("above"), F.count_if(F.col("d") < 0).alias("below"),
        F.avg("ad").alias("mae"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"),
    )
    return attach_row(plain, quantiles(d, [], "ad", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}))


def density(df: DataFrame, keys: list[str], at: str, unit: str) -> DataFrame:
    """Events per time unit of each key: units seen, mean, median, 95th percentile and maximum."""
    cells = df.groupBy(*keys, truncate(at, unit).alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    plain = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.avg("_n").alias("mean"), F.max("_n").alias("max"))
    return plain.join(quantiles(cells, keys, "_n", {"median": 0.5, "p95": 0.95}), keys)


def gap_statistics(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Seconds between consecutive events of each key: count, mean, median, 90th percentile."""
    gaps = over_rows(df.select(*keys, *order), keys, order, 1, {"_gap": lambda r: (F.col(order[0]) - r.lag(order[0])) / F.lit(SECOND)})
    plain = gaps.groupBy(*keys).agg(F.count("_gap").alias("n"), F.avg("_gap").alias("mean"), F.min("_gap").alias("min"))
    return plain.join(quantiles(gaps, keys, "_gap", {"median": 0.5, "p90": 0.9}), keys)


def multiplicity(df: DataFrame, key: str) -> DataFrame:
    """How many keys occur once, twice, …"""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("times"))
    return g.groupBy("times").agg(F.count(F.lit(1)).alias("keys"))


def distinct_list(df: DataFrame, keys: list[str], column: str, name: str, separator: str = "|") -> DataFrame:
    """Distinct values of a low-cardinality column per group, joined in order, and their number.

    Distinct pairs are formed first; a group then holds as many elements as the column has values.
    """
    pairs = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    return pairs.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(column).cast("string"))), separator).alias(name), F.count(F.lit(1)).alias(f"n_{name}")
    )


def mismatches(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows where both sides are present and differ, per named pair."""
    cells = []
    for name, (a, b) in pairs.items():
        both = a.isNotNull() & b.isNotNull()
        cells.append(F.struct(F.lit(name).alias("pair"), F.count_if(both).alias("both"), F.count_if(both & (a != b)).alias("differ")))
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def enrichment(df: DataFrame, column: str, subset: Column, min_n: int, top: int) -> DataFrame:
    """Values over-represented in a subset: their share there, their share overall and the lift."""
    inside = F.coalesce(subset, F.lit(False))
    totals = df.agg(F.count(F.lit(1)).alias("_all"), F.count_if(inside).alias("_sub"))
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_sub")).where(F.col("n") >= min_n)
    g = attach_row(g, totals)
    g = g.withColumn("share_sub", ratio(F.col("n_sub"), F.col("_sub"))).withColumn("share_all", F.col("n") / F.col("_all"))
    return g.withColumn("lift", F.col("share_sub") / F.col("share_all")).drop("_all", "_sub").orderBy(F.col("lift").desc(), column).limit(top)


def resolution(df: DataFrame, at: str) -> DataFrame:
    """Distinct instants, minutes and hours of a clock and the share of rows with seconds or fractions."""
    us = F.col(at)
    instants = df.agg(
        F.count(us).alias("n"), F.countDistinct(us).alias("instants"), F.countDistinct(truncate(at, "minute")).alias("minutes"), F.countDistinct(truncate(at, "hour")).alias("hours"),
        F.avg((us % (60 * SECOND) != 0).cast("double")).alias("share_seconds"), F.avg((us % SECOND != 0).cast("double")).alias("share_fraction"),
    )
    return instants

