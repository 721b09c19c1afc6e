"""Frames counted in rows: lags and "last n rows" statistics, and windows that end at the previous row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.clock import col
from eventloom.operators.rolling import frame_statistics
from eventloom.operators.slices import slice_width, solid_keys, time_slice, with_position


CHUNK_ROWS = 100_000


def _slice_of(df: DataFrame, order: list[str], slice_us: int | None) -> Column:
    width = F.lit(slice_us) if slice_us else slice_width([(df, order[0])])
    return time_slice(F.col(order[0]), width)


class Rows:
    """Window builder handed to feature functions: ``rows(-5, -1)`` or ``.order`` for lag."""

    def __init__(self, order):
        self.order = order

    def __call__(self, lo: int, hi: int):
        return self.order.rowsBetween(lo, hi)

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(col(c), k).over(self.order)


def over_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    reach: int,
    features: dict[str, Callable[[Rows], Column]],
    slice_us: int | None = None,
    chunk: int | None = None,
    base: DataFrame | None = None,
    spread_ties: bool = False,
) -> DataFrame:
    """Append features over at most ``reach`` preceding rows of each key.

    ``base`` may name the source of ``df`` (same rows, keys and times, fewer features): slices and row
    counts are then read from it, so a chain of calls does not repeat its own plan. ``spread_ties`` also
    spreads rows that share one time, for coarse clocks.

    ``order`` starts with a microsecond column and is unique within a key. All rows come back: a null key is a key of its
    own, and rows without a time have null features and count for no other row. Every key is cut into chunks
    of equal row count; the last ``reach`` rows of a chunk are copied into the next one as context.
    """
    source = df if base is None else base
    cut = F.coalesce(_slice_of(source, order, slice_us), F.lit(0))
    names = df.columns
    df, keys_in = solid_keys(df, keys, order[0])
    source, keys_in = solid_keys(source, keys, order[0])
    timed = F.col(order[0]).isNotNull()
    keys = keys_in
    placed = with_position(df.withColumn("_slice", cut), keys, order, "_slice", "_pos", source.withColumn("_slice", cut), spread_ties, solid=True)
    at = F.col("_pos") - 1
    chunk = max(chunk or CHUNK_ROWS, reach + 1)
    home = F.floor(at / F.lit(chunk))
    copies = F.when(F.pmod(at, F.lit(chunk)) >= chunk - reach, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.withColumn("_home", home).withColumn("_chunk", F.explode(copies))
    rows = Rows(Window.partitionBy(*keys, "_chunk").orderBy("_pos"))
    done = spread.select(
        *names, "_home", "_chunk", *[F.when(timed, make(rows)).alias(n) for n, make in features.items()]
    )
    return done.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def full_only(agg: Column, value: Column | str, window, n: int) -> Column:
    """``agg`` over the frame, null unless it holds ``n`` non-null values."""
    return F.when(F.count(col(value)).over(window) == n, agg)


def nearest_percentile(values: Column, q: float, ordered: bool = False) -> Column:
    """Nearest-rank percentile of an array of non-null values; ``ordered`` if it is sorted already."""
    ordered = values if ordered else F.sort_array(values)
    at = F.floor((F.size(ordered) - 1) * F.lit(q) + F.lit(0.5)).cast("int") + 1
    return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at))


def previous_row_windows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, str],
    widths: dict[str, int],
    stats: tuple[str, ...] = ("mean", "med", "p90", "std"),
    slice_us: int | None = None,
) -> DataFrame:
    """Statistics of the time window that ends at the previous row: rows up to it, later than t_prev - w.

    The window of a row is ``(t - w, t]`` cut at the row itself, so rows with an equal time that come
    later in the order stay out; the result is then moved one row on. Columns are ``<value>_<stat>_<width>``.
    """
    names = {f"{v}_{s}_{w}": (c, us, s) for v, c in values.items() for w, us in widths.items() for s in stats}
    now = frame_statistics(df, keys, order, {f"_now_{n}": f for n, f in names.items()}, slice_us=slice_us)
    moved = over_rows(now, keys, order, 1, {n: (lambda r, n=n: r.lag(f"_now_{n}")) for n in names}, base=df)
    return moved.drop(*[f"_now_{n}" for n in names])
