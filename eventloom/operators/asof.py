"""As-of, previous-event and nearest-in-range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.timeline import Feature, Stream, trailing


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_at: str,
    take: dict[str, str],
    right_keys: list[str] | None = None,
    tie: str | None = None,
    strict: bool = False,
    within_us: tuple[int, int] | None = None,
    slice_us: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """The latest right row at or before (``strict``: before) each left row's time, or nulls.

    ``take`` maps output names to right columns. Of right rows sharing key and time the one with the
    largest ``tie`` is used. ``within_us=(low, high)`` blanks matches whose age is outside ``[low, high]``.
    """
    payload = F.struct(F.col(right_at).alias("_at"), *[F.col(c).alias(n) for n, c in take.items()])
    side = Stream(right, right_keys or keys, right_at, {"_hit": payload}, F.col(tie) if tie else None)
    got = trailing(left, keys, left_at, [side], [Feature("_hit", "last", "_hit", None, -1 if strict else 0)], slice_us, base)
    hit = F.col("_hit")
    if within_us is not None:
        age = F.col(left_at) - F.col("_hit._at")
        hit = F.when((age >= within_us[0]) & (age <= within_us[1]), hit)
    got = got.withColumn("_hit", hit)
    return got.select(*left.columns, *[F.col(f"_hit.{n}").alias(n) for n in take])


def previous_event(df: DataFrame, keys: list[str], at: str, take: dict[str, str], tie: str | None = None, **kw) -> DataFrame:
    """The last event of the same keys strictly before each row; a row never meets itself."""
    return asof(df, df, keys, at, at, take, tie=tie, strict=True, **kw)


def next_after(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, name: str, right_keys: list[str] | None = None,
    slice_us: int | None = None, base: DataFrame | None = None,
) -> DataFrame:
    """Time of the first right event strictly after each left time (an as-of on the mirrored axis)."""
    flipped_left = left.withColumn("_flip", -F.col(left_at))
    flipped_right = right.select(*(right_keys or keys), (-F.col(right_at)).alias("_flip"))
    side = Stream(flipped_right, right_keys or keys, "_flip", {"_next": F.col("_flip")})
    asked = None if base is None else base.withColumn("_flip", -F.col(left_at))
    got = trailing(flipped_left, keys, "_flip", [side], [Feature("_next", "max", "_next", None, -1)], slice_us, asked)
    return got.withColumn(name, -F.col("_next")).select(*left.columns, name)


def nearest_in_range(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_at: str,
    right_id: str,
    right_at: str,
    lo_us: int,
    hi_us: int,
    take: dict[str, str],
    right_keys: list[str] | None = None,
    slice_us: int | None = None,
) -> DataFrame:
    """The right row of the same keys nearest in time inside ``[t + lo, t + hi]`` (``lo <= 0 <= hi``).

    Ties go to the smaller right id. The nearest row is either the last one at or before t or the first
    one after it, so two as-of lookups on the timeline replace the range join and no pairs are formed.
    """
    if lo_us > 0 or hi_us < 0:
        raise ValueError("the range must contain the left time")
    rk = right_keys or keys
    body = F.struct(F.col(right_at).alias("at"), F.col(right_id).alias("id"), *[F.col(c).alias(n) for n, c in take.items()])
    back = Stream(right, rk, right_at, {"_back": body}, -F.col(right_id))
    got = trailing(left, keys, left_at, [back], [Feature("_back", "last", "_back", None, 0)], slice_us)
    mirrored = right.withColumn("_flip", -F.col(right_at))
    ahead = Stream(mirrored, rk, "_flip", {"_ahead": body}, -F.col(right_id))
    got = trailing(
        got.withColumn("_flip", -F.col(left_at)), keys, "_flip", [ahead], [Feature("_ahead", "last", "_ahead", None, -1)], slice_us,
        left.withColumn("_flip", -F.col(left_at)),
    )
    back_gap = F.col(left_at) - F.col("_back.at")
    ahead_gap = F.col("_ahead.at") - F.col(left_at)
    back_ok = F.when(back_gap <= F.lit(-lo_us), F.struct(back_gap.alias("gap"), F.col("_back.id").alias("id"), F.col("_back").alias("row")))
    ahead_ok = F.when(ahead_gap <= F.lit(hi_us), F.struct(ahead_gap.alias("gap"), F.col("_ahead.id").alias("id"), F.col("_ahead").alias("row")))
    best = F.when(
        back_ok.isNull()
        | (ahead_ok["gap"] < back_ok["gap"])
        | ((ahead_ok["gap"] == back_ok["gap"]) & (ahead_ok["id"] < back_ok["id"])),
        F.coalesce(ahead_ok, back_ok),
    ).otherwise(back_ok)
    chosen = got.withColumn("_best", best)
    return chosen.select(*left.columns, *[F.col(f"_best.row.{n}").alias(n) for n in take])


def exists_in_range(
    left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str,
    lo_us: int, hi_us: int, name: str, right_keys: list[str] | None = None,
) -> DataFrame:
    """Flag left rows that have any right row of the same keys inside the range.

    Counted on the timeline of the key, so no pairs are formed at all.
    """
    shifted = left.withColumn("_end", F.col(left_at) + F.lit(hi_us))
    side = Stream(right, right_keys or keys, right_at, {"_n": F.lit(1)})
    got = trailing(shifted, keys, "_end", [side], [Feature("_n", "sum", "_n", lo_us - hi_us, 0)])
    return got.withColumn(name, F.coalesce(F.col("_n"), F.lit(0)) > 0).select(*left.columns, name)


def previous_bin(states: DataFrame, keys: list[str], bin_col: str, value: str, name: str) -> DataFrame:
    """The value of the previous time bin of the same keys, else the bin's own value."""
    earlier = states.select(*keys, (F.col(bin_col) + 1).alias(bin_col), F.col(value).alias("_before"))
    return states.join(earlier, [*keys, bin_col], "left").withColumn(name, F.coalesce("_before", value)).drop("_before")


def pair_by_id(df: DataFrame, pair_id: str, order: list[str], take: dict[str, str]) -> DataFrame:
    """Ids that occur exactly twice: the earlier row's columns as ``a_*``, the later one's as ``b_*``."""
    body = F.struct(*[F.col(c).alias(n) for n, c in take.items()])
    rank = F.struct(*order)
    both = df.where(F.col(pair_id).isNotNull()).groupBy(pair_id).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(body, rank).alias("_a"), F.max_by(body, rank).alias("_b")
    )
    return both.where("_n = 2").select(
        pair_id, *[F.col(f"_a.{n}").alias(f"a_{n}") for n in take], *[F.col(f"_b.{n}").alias(f"b_{n}") for n in take]
    )


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the one that ranks highest; a partial aggregate, not a window."""
    rest = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
