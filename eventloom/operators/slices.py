"""Slices: ordered pieces of a key, small enough for one task each.

One key may hold a large share of all rows, so no operator of this package orders a whole key in a
single task. The order axis (time or a value) is cut into slices, windows run per ``(key, slice)``,
and whatever has to cross a slice border is carried over from one summary row per slice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.clock import whole_div

UNBOUNDED = Window.unboundedPreceding


ROWS_PER_SLICE = 200_000


def solid_keys(df: DataFrame, keys: list[str], at: str | None = None) -> tuple[DataFrame, list[str]]:
    """Key columns that hold no null: each key with a stand-in, and one number that says which keys, or the time, were null.

    A null key is then a group of its own, and rows without a time are a group apart, so neither is lost in a join.
    """
    kinds = dict(df.dtypes)
    plain = {f"_key{i}": F.coalesce(F.col(k), F.lit("1970-01-01" if kinds[k] in ("date", "timestamp", "timestamp_ntz") else "0" if kinds[k] != "boolean" else "false").cast(kinds[k])) for i, k in enumerate(keys)}
    nulls = sum((F.when(F.col(k).isNull(), F.lit(2**i)).otherwise(F.lit(0)) for i, k in enumerate(keys + ([at] if at else []))), F.lit(0))
    return df.withColumns(plain | {"_key_nulls": nulls}), [*plain, "_key_nulls"]


def time_slice(at: Column, width: Column | int) -> Column:
    return whole_div(at, width)


def slice_width(sources: list[tuple[DataFrame, str]], rows: int | None = None) -> Column:
    """Slice width (µs) that leaves about ``rows`` (``ROWS_PER_SLICE``) rows per slice even if one key held every row.

    A scalar subquery over count, minimum and maximum of the time columns; parquet answers it from one
    narrow column. Pass a width of your own to the operators to save that scan.
    """
    narrow = reduce(lambda a, b: a.unionByName(b), [df.select(F.col(at).alias("t")) for df, at in sources])
    pieces = F.ceil(F.count("t") / F.lit(float(rows or ROWS_PER_SLICE)))
    span = (F.max("t") - F.min("t")).cast("double") / F.greatest(pieces, F.lit(1))
    return narrow.agg(F.coalesce(F.greatest(F.ceil(span), F.lit(1)), F.lit(1)).cast("long").alias("w")).scalar()


def value_slice(x: Column, per_octave: int = 64) -> Column:
    """A slice number that never falls when ``x`` (a double) grows: signed, logarithmic, about 1 % wide."""
    def octave(v: Column) -> Column:
        return F.floor(F.log2(v) * F.lit(float(per_octave))) + F.lit(1_000_000)

    return (
        F.when(x > 0, octave(x)).when(x < 0, -octave(-x)).otherwise(F.lit(0)).cast("long")
    )


@dataclass(frozen=True)
class Running:
    """A running aggregate over everything earlier in the key's order.

    ``agg`` is sum, max, min or last (last non-null). ``through`` is 0 to take the current row (or all
    its peers in range mode) in and -1 to stop before it.
    """

    name: str
    agg: str
    value: Column
    through: int = -1


def _total(agg: str, value: Column, order: list[str]) -> Column:
    if agg == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*[F.col(o) for o in order])))
    return {"sum": F.sum, "max": F.max, "min": F.min}[agg](value)


def _over(agg: str, value: Column, window) -> Column:
    if agg == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[agg](value).over(window)


def combine(agg: str, earlier: Column, here: Column) -> Column:
    """Join an aggregate of the earlier slices with the one inside the slice."""
    if agg == "sum":
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(here, F.lit(0))
    if agg == "last":
        return F.coalesce(here, earlier)
    return (F.greatest if agg == "max" else F.least)(earlier, here)


def carried(
    df: DataFrame, keys: list[str], slice_col: str, order: list[str], items: list[Running], same_as: list[str] | None = None
) -> DataFrame:
    """One row per (key, slice): the aggregates of all earlier slices as ``_in_<name>``.

    ``same_as`` names numeric columns read here for no other reason than that the caller reads them too:
    with equal columns both branches have the same shuffle below them and Spark runs it once.
    """
    totals = df.groupBy(*keys, slice_col).agg(
        *[_total(i.agg, i.value, order).alias(f"_t_{i.name}") for i in items],
        *[F.max(c).alias(f"_same_{c}") for c in same_as or []],
    )
    for c in same_as or []:
        totals = totals.where(F.col(f"_same_{c}").isNull() | (F.col(f"_same_{c}") >= 0))
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(UNBOUNDED, -1)
    return totals.select(
        *keys, slice_col, *[_over(i.agg, F.col(f"_t_{i.name}"), earlier).alias(f"_in_{i.name}") for i in items]
    )


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_col: str,
    items: list[Running],
    peers: bool = False,
    same_as: list[str] | None = None,
    solid: bool = False,
) -> DataFrame:
    """Append running aggregates; a null key is a key of its own.

    ``slice_col`` must never fall along ``order``. With ``peers`` the single long order column is read
    as a range, so rows with an equal value share their result; otherwise rows are counted one by one.
    ``solid`` says that no key is null, or that rows with a null key don't matter to the caller.
    """
    names = df.columns
    if keys and not solid:
        df, keys = solid_keys(df, keys)
    carry = carried(df, keys, slice_col, order, items, same_as)
    base = Window.partitionBy(*keys, slice_col).orderBy(*order)
    joined = df.join(carry, [*keys, slice_col], "left")
    out = []
    for i in items:
        frame = base.rangeBetween(UNBOUNDED, i.through) if peers else base.rowsBetween(UNBOUNDED, i.through)
        out.append(combine(i.agg, F.col(f"_in_{i.name}"), _over(i.agg, i.value, frame)).alias(i.name))
    return joined.select(*[F.col(c) for c in names], *out)


def with_position(
    df: DataFrame, keys: list[str], order: list[str], slice_col: str, name: str = "position",
    base: DataFrame | None = None, spread_ties: bool = False, limit: int | None = None, solid: bool = False,
) -> DataFrame:
    """1-based position of every row in its key's total order (``order`` must be unique within a key).

    A null key is a key of its own (``solid`` says there is none). ``base`` may name a cheaper DataFrame with the same rows, keys
    and slices to count in. With ``spread_ties`` slices of more than ``limit`` rows (five slices' worth) are cut again: into pieces
    of their first order column's range, by order values, and by ranges of the last order column (a whole number), so that one
    value shared by very many rows is spread too. Offsets are summed in two levels, over pieces and inside each piece.
    """
    names = df.columns
    source = df if base is None else base
    if keys and not solid:
        source, _ = solid_keys(source, keys)
        df, keys = solid_keys(df, keys)
    counts = source.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_rows"))
    if not spread_ties:
        earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(UNBOUNDED, -1)
        offsets = counts.select(*keys, slice_col, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
        inside = F.row_number().over(Window.partitionBy(*keys, slice_col).orderBy(*order))
        placed = df.join(offsets, [*keys, slice_col], "left")
        return placed.select(*names, (F.col("_offset") + inside).cast("long").alias(name))

    most, first = limit or 5 * ROWS_PER_SLICE, F.col(order[0]).cast("double")
    counts = source.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_rows"), F.min(first).alias("_lo"), F.max(first).alias("_hi"))
    heavy = counts.where(F.col("_rows") > most).select(*keys, slice_col, "_lo", "_hi", F.ceil(F.col("_rows") / most).alias("_pieces"))
    width = slice_width([(source, order[-1])])
    share = (first - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    piece = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.col("_pieces")), F.col("_pieces") - 1)
    columns = {f"_p{i}": F.col(c) for i, c in enumerate(order[:-1])} | {"_p_tie": whole_div(F.col(order[-1]), width)}

    def cut(d: DataFrame) -> DataFrame:
        marked = d.join(heavy, [*keys, slice_col], "left").withColumn("_piece", F.coalesce(piece, F.lit(0)))
        return marked.withColumns({n: F.when(F.col("_pieces").isNotNull(), c).otherwise(F.lit(0)) for n, c in columns.items()})

    whole, group = [*keys, slice_col, "_piece"], [*keys, slice_col, "_piece", *columns]
    sizes = cut(source).groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    inner = Window.partitionBy(*whole).orderBy(*columns).rowsBetween(UNBOUNDED, -1)
    # a row for each slice and piece: no more than rows / limit beyond the slices
    outer = Window.partitionBy(*keys).orderBy(slice_col, "_piece").rowsBetween(UNBOUNDED, -1)
    pieces = sizes.groupBy(*whole).agg(F.sum("_rows").alias("_rows")).select(*whole, F.coalesce(F.sum("_rows").over(outer), F.lit(0)).alias("_before"))
    offsets = sizes.select(*group, F.coalesce(F.sum("_rows").over(inner), F.lit(0)).alias("_offset")).join(pieces, whole)
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    placed = cut(df).join(offsets, group, "left")
    return placed.select(*names, (F.col("_before") + F.col("_offset") + inside).cast("long").alias(name))


def text_slice(text: Column, size: int = 3) -> Column:
    """A slice number from the first bytes of a string, in the order Spark sorts strings."""
    head = F.hex(F.substring(F.encode(text, "UTF-8"), 1, size))
    return F.conv(F.rpad(head, 2 * size, "0"), 16, 10).cast("long")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach the single row of ``row`` to every row, through one scalar subquery and no join."""
    one = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_row", one).select(*df.columns, *[F.col(f"_row.{c}").alias(c) for c in row.columns])

