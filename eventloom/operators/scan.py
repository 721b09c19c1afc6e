"""Scans of composed functions: a value that each row of a key changes, in one pass over the rows.

A row turns the value x of the row before it into ``max(floor, x + add)``, or into ``start`` whatever x was (a reset). Such
functions compose into one of the same form, so the rows of a slice are composed first, then the slices of a key, and what comes
in at a slice's border is put into the composed functions of its rows. Within a slice the composition is three running
aggregates over one order: the number of resets, the sum of what is added, and the highest of ``floor - sum`` since the last
reset, which is the maximum of pairs (resets, floor - sum). Run lengths, numbers of stretches, times since a change and reflected
workloads are such scans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.slices import slice_width, solid_keys, time_slice

#: Reads an input by its name.
Input = Callable[[str], Column]


@dataclass(frozen=True)
class Step:
    """What a row does to the value: ``start`` where ``reset`` holds, else ``max(floor, value + add)``. Null adds nothing, sets no floor."""

    add: Column
    floor: Column | None = None
    reset: Column | None = None
    start: Column | None = None


def _composed(rows: DataFrame, window, reset: Column, add: Column, level: Column) -> DataFrame:
    """_resets, _sum and _high: the functions of all rows of the window up to this one as a single one."""
    out = rows.withColumn("_reset", reset).withColumn("_add", add).withColumn("_level", level)
    out = out.withColumn("_resets", F.sum(F.col("_reset").cast("long")).over(window)).withColumn("_sum", F.sum("_add").over(window))
    best = F.max(F.struct("_resets", (F.col("_level") - F.col("_sum")).alias("v"))).over(window)
    return out.withColumn("_high", best["v"] + F.col("_sum")).drop("_reset", "_add", "_level")


def _put(x: Column, resets: Column, total: Column, high: Column) -> Column:
    """The composed function's value for x."""
    return F.when(resets > 0, high).otherwise(F.greatest(high, x + total))


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    inputs: dict[str, Column],
    step: Callable[[Input, Input, Column], Step],
    kind: str = "double",
    shift: bool = False,
    slice_us: int | None = None,
) -> DataFrame:
    """Append the value after each row; with ``shift`` the one before it (null on a key's first row). It is 0 before a key's first row.

    ``step(now, before, first)`` gives a row's function: ``now`` and ``before`` read ``inputs`` of this row and the one before it (null
    on the first), ``first`` says that the row is its key's first. ``order`` starts with a microsecond column and is unique within a
    key. All rows come back: a null key is a key of its own, and a row without a time has null. ``kind`` is double or bigint.
    """
    width = F.lit(slice_us) if slice_us else slice_width([(df, order[0])])
    rows, solid = solid_keys(df.withColumns({f"_in_{n}": c for n, c in inputs.items()}), keys, order[0])
    rows = rows.withColumn("_slice", F.coalesce(time_slice(F.col(order[0]), width), F.lit(0)))
    zero, no_level = F.lit(0).cast(kind), F.lit(None).cast(kind)
    place = [*solid, "_slice"]
    inside = Window.partitionBy(*place).orderBy(*order)

    def parts(s: Step) -> tuple[Column, Column, Column, Column]:
        reset = F.coalesce(s.reset, F.lit(False)) if s.reset is not None else F.lit(False)
        start = s.start.cast(kind) if s.start is not None else no_level
        return reset, F.coalesce(s.add.cast(kind), zero), s.floor.cast(kind) if s.floor is not None else no_level, start

    now = lambda n: F.col(f"_in_{n}")
    rows = rows.withColumns({f"_be_{n}": F.lag(f"_in_{n}").over(inside) for n in inputs} | {"_head": F.row_number().over(inside) == 1})
    reset, add, floor, start = parts(step(now, lambda n: F.col(f"_be_{n}"), F.lit(False)))
    # what the first row of a slice does is known once the row before it is: here it leaves the value as it is
    reset, head = ~F.col("_head") & reset, F.col("_head")
    rows = _composed(rows, inside, reset, F.when(head | reset, zero).otherwise(add), F.when(head, no_level).when(reset, start).otherwise(floor))
    rows = rows.withColumn("_past", F.lag(F.struct("_resets", "_sum", "_high")).over(inside))

    when = F.struct(*order)
    both = F.struct(*[now(n).alias(n) for n in inputs], *[F.lit(0).alias("_")])
    # all columns are read here as well: with equal columns the shuffle below is run once
    ends = rows.groupBy(*place).agg(F.min_by(both, when).alias("_one"), F.max_by(both, when).alias("_end"), F.max_by(F.struct("_resets", "_sum", "_high", *df.columns), when).alias("_rest"))
    along = Window.partitionBy(*solid).orderBy("_slice")
    ends = ends.withColumn("_before", F.lag("_end").over(along)).withColumn("_first", F.row_number().over(along) == 1)
    reset, add, floor, start = parts(step(lambda n: F.col(f"_one.{n}"), lambda n: F.col(f"_before.{n}"), F.col("_first")))
    ends = ends.withColumns({"_r1": reset, "_a1": add, "_f1": floor, "_s1": start})
    closed, total, high = F.col("_rest._resets") > 0, F.col("_rest._sum"), F.col("_rest._high")
    whole = F.when(closed, high).when(F.col("_r1"), F.greatest(high, F.col("_s1") + total)).otherwise(F.greatest(high, F.col("_f1") + total))
    ends = _composed(ends, along, closed | F.col("_r1"), F.when(closed | F.col("_r1"), zero).otherwise(F.col("_a1") + total), whole)
    ends = ends.withColumn("_enter", F.lag(_put(zero, F.col("_resets"), F.col("_sum"), F.col("_high"))).over(along))
    entered = F.when(F.col("_r1"), F.col("_s1")).otherwise(F.greatest(F.col("_f1"), F.coalesce("_enter", zero) + F.col("_a1")))
    borders = ends.select(*place, "_enter", entered.alias("_x"))

    got = rows.join(borders, place, "left")
    value = _put(F.col("_x"), F.col("_resets"), F.col("_sum"), F.col("_high"))
    if shift:
        value = F.when(head, F.col("_enter")).otherwise(_put(F.col("_x"), F.col("_past._resets"), F.col("_past._sum"), F.col("_past._high")))
    return got.select(*df.columns, F.when(F.col(order[0]).isNotNull(), value).alias(name))


def _changed(now: Input, before: Input, first: Column) -> Column:
    return first | ~now("value").eqNullSafe(before("value"))


def run_length(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str, shift: bool = True, slice_us: int | None = None) -> DataFrame:
    """Length of the current run of ``flag`` (null counts as false); with ``shift`` the run that ended at the previous row."""

    def step(now: Input, before: Input, first: Column) -> Step:
        return Step(add=F.lit(1), reset=~now("flag"), start=F.lit(0))

    return scan(df, keys, order, name, {"flag": F.coalesce(flag, F.lit(False))}, step, "bigint", shift, slice_us)


def islands(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "island", slice_us: int | None = None) -> DataFrame:
    """Number the stretches of equal consecutive values of each key, starting at 1."""
    return scan(df, keys, order, name, {"value": value}, lambda now, before, first: Step(add=_changed(now, before, first)), "bigint", False, slice_us)


def since_change(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, slice_us: int | None = None) -> DataFrame:
    """Microseconds since the value last changed (0 on the row that changes it)."""

    def step(now: Input, before: Input, first: Column) -> Step:
        return Step(add=F.lit(0), reset=_changed(now, before, first), start=now("at"))

    got = scan(df, keys, order, "_changed_at", {"value": value, "at": F.col(order[0])}, step, "bigint", False, slice_us)
    return got.withColumn(name, F.col(order[0]) - F.col("_changed_at")).drop("_changed_at")


def workload(
    df: DataFrame, keys: list[str], order: list[str], arrivals: Column, drain_us: float, idle_us: int, name: str = "workload", slice_us: int | None = None
) -> DataFrame:
    """Reflected workload ``B = max(0, B + a - dt / drain)`` per key, restarted with the row's own arrivals after an idle gap."""

    def step(now: Input, before: Input, first: Column) -> Step:
        gap = now("at") - before("at")
        return Step(add=now("in") - gap / F.lit(float(drain_us)), floor=F.lit(0.0), reset=first | (gap > idle_us), start=F.greatest(now("in"), F.lit(0.0)))

    return scan(df, keys, order, name, {"in": F.coalesce(arrivals.cast("double"), F.lit(0.0)), "at": F.col(order[0])}, step, "double", False, slice_us)
