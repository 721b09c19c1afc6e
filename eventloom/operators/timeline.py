"""Trailing and cumulative features of event streams, read at query times.

An event counts for the query times between its entry into the frame and its exit from it. Streams are
therefore read as changes (plus on entry, minus on exit) on the query axis and reduced, together with the
query times, to one row per ``(key, time)``; partial aggregation does most of it before the shuffle, so
any number of ties costs one row. Every feature is then one running aggregate per ``(key, slice)`` plus
the total of all earlier slices: the work is linear in the events however wide the frames are. Results go
back to the query rows through an equi-join on ``(key, time)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.clock import col
from eventloom.operators.slices import Running, running, slice_width, solid_keys, time_slice


@dataclass(frozen=True)
class Stream:
    """Events with a time column and named measures; rows without a time are left out.

    ``keys`` names the key columns in the order of the query keys. ``tie`` ranks payloads that share a
    key and time (used by ``last`` only).
    """

    df: DataFrame
    keys: list[str]
    at: str
    measures: dict[str, Column]
    tie: Column | None = None


@dataclass(frozen=True)
class Feature:
    """``agg`` of ``measure`` over the frame ``[t + lo, t + hi]`` in microseconds; ``lo=None`` is open."""

    name: str
    agg: str
    measure: str
    lo: int | None = field(default=None)
    hi: int = -1


def before(name: str, agg: str, measure: str, width: int | None) -> Feature:
    """Frame ``[t - width, t)``: strictly before the query time."""
    return Feature(name, agg, measure, None if width is None else -width, -1)


def until(name: str, agg: str, measure: str, width: int | None) -> Feature:
    """Frame ``(t - width, t]``: the query time itself counts."""
    return Feature(name, agg, measure, None if width is None else -width + 1, 0)


def closed(name: str, agg: str, measure: str, width: int) -> Feature:
    """Frame ``[t - width, t]``."""
    return Feature(name, agg, measure, -width, 0)


def _moments(stream: Stream, features: list[Feature]) -> DataFrame | None:
    """The stream as changes on the query axis: a row per (event, moment) with one column per feature.

    An event at e lies in ``[t + lo, t + hi]`` from query time ``e - hi`` on and leaves at
    ``e - lo + 1``, so it enters with its measure and leaves with the negated one.
    """
    mine = [f for f in features if f.measure in stream.measures]
    if not mine:
        return None
    lasts = [f for f in mine if f.agg == "last"]
    enter = {-f.hi for f in mine}
    leave = {-f.lo + 1 for f in mine if f.lo is not None}
    options = []
    for off in sorted(enter | leave):
        cells = [(F.col("__e") + F.lit(off)).alias("__t")]
        for f in mine:
            m = F.col(f"__m_{f.measure}")
            value = F.lit(None)
            if -f.hi == off:
                value = m
            elif f.lo is not None and -f.lo + 1 == off:
                value = -m
            cells.append(value.alias(f"__f_{f.name}"))
        cells += [(F.col("__tie") if -f.hi == off else F.lit(None)).alias(f"__tie_{f.name}") for f in lasts]
        options.append(F.struct(*cells))
    keys = [F.col(k).alias(f"__k{i}") for i, k in enumerate(stream.keys)]
    # what is not a finite number would stay in every later sum of its key: it counts as missing
    summed = {f.measure for f in mine if f.agg == "sum"}
    finite = lambda c: F.when(F.abs(c.cast("double")) < F.lit(float("inf")), c)
    measures = [(finite(stream.measures[m]) if m in summed else stream.measures[m]).alias(f"__m_{m}") for m in sorted({f.measure for f in mine})]
    tie = (stream.tie if stream.tie is not None else F.lit(0)).alias("__tie")
    base = stream.df.where(F.col(stream.at).isNotNull()).select(*keys, F.col(stream.at).alias("__e"), *measures, tie)
    kept = [c for c in base.columns if c.startswith("__k")]
    if len(options) == 1:
        return base.select(*kept, options[0].alias("__x")).select(*kept, "__x.*")
    return base.select(*kept, F.inline(F.array(*options)))


def _fold(f: Feature) -> Column:
    c = F.col(f"__f_{f.name}")
    if f.agg == "last":
        return F.max_by(c, F.when(c.isNotNull(), F.col(f"__tie_{f.name}")))
    return {"sum": F.sum, "max": F.max, "min": F.min}[f.agg](c)


def trailing(
    queries: DataFrame,
    keys: list[str],
    at: str,
    streams: list[Stream],
    features: list[Feature],
    slice_us: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """``queries`` with one column per feature. Sums over nothing are 0, other aggregates null.

    ``base`` is a cheap DataFrame with the same key and time columns that covers the query times; give
    the source of ``queries`` when ``queries`` itself already carries joined features, so that a chain of
    calls reads its source and not its own plan again.

    Bounded frames are for sums only (entries minus exits); see :func:`over_range` for other aggregates.
    Rows with a null key have null features. Measure names are unique over the streams.
    """
    for f in features:
        if f.lo is not None and f.agg != "sum":
            raise ValueError(f"{f.name}: bounded frames are for sums")
    ks = [f"__k{i}" for i in range(len(keys))]
    parts = [p for p in (_moments(s, features) for s in streams) if p is not None]
    times = queries if base is None else base
    asked = times.where(F.col(at).isNotNull())
    parts.append(asked.select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], F.col(at).alias("__t"), F.lit(1).alias("__q")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    line = union.groupBy(*ks, "__t").agg(F.max("__q").alias("__q"), *[_fold(f).alias(f"__f_{f.name}") for f in features])
    # streams count too: few query times may face very many events
    sized = [(times, at)] + [(s.df, s.at) for s in streams if s.df is not times and s.df is not queries]
    width = F.lit(slice_us) if slice_us else slice_width(sized)
    line = line.withColumn("__slice", time_slice(F.col("__t"), width))
    items = [Running(f.name, f.agg, F.col(f"__f_{f.name}"), 0) for f in features]
    got = running(line, ks, ["__t"], "__slice", items, same_as=["__q"], solid=True).where("__q = 1")
    names = {a: k for a, k in zip(ks, keys)} | {"__t": at}
    found = got.select(*[F.col(a).alias(n) for a, n in names.items()], *[f.name for f in features])
    joined = queries.join(found, [*keys, at], "left")
    return joined.select(*queries.columns, *[f.name for f in features])


def events(df: DataFrame, keys: list[str], at: str, tie: Column | None = None, **measures: Column | str) -> Stream:
    """A stream whose measures are given by name; ``events(df, ["k"], "t", n=F.lit(1))`` counts rows."""
    return Stream(df, keys, at, {n: col(m) for n, m in measures.items()}, tie)


class Ranges:
    """Window builder for :func:`over_range`: ``ranges(lo, hi)`` in microseconds."""

    def __init__(self, order):
        self.order = order

    def __call__(self, lo: int, hi: int):
        return self.order.rangeBetween(lo, hi)


def over_range(
    df: DataFrame,
    keys: list[str],
    at: str,
    reach: int,
    features: dict[str, Callable[[Ranges], Column]],
    slice_us: int | None = None,
) -> DataFrame:
    """Append features over bounded time frames of the rows themselves (percentiles, lists).

    For frames whose aggregate cannot be built from per-time totals; cost grows with the frame, so the
    look-back should stay short. All rows come back: a null key is a key of its own, rows without a time have null features. Rows within ``reach`` of the next slice are copied into it as context.
    """
    names = df.columns
    df, keys = solid_keys(df, keys, at)
    width = max(slice_us or 8 * reach, reach, 1)
    home = F.coalesce(time_slice(F.col(at), F.lit(width)), F.lit(0))
    nxt = F.col("_home") + 1
    copies = F.when(F.col(at) + F.lit(reach) >= nxt * F.lit(width), F.array("_home", nxt)).otherwise(F.array("_home"))
    spread = df.withColumn("_home", home).withColumn("_slice", F.explode(copies))
    ranges = Ranges(Window.partitionBy(*keys, "_slice").orderBy(at))
    timed = F.col(at).isNotNull()
    done = spread.select(*names, "_home", "_slice", *[F.when(timed, f(ranges)).alias(n) for n, f in features.items()])
    return done.where(F.col("_home") == F.col("_slice")).drop("_home", "_slice")


def between_open(
    queries: DataFrame,
    keys: list[str],
    start: str,
    end: str,
    stream: Stream,
    measures: dict[str, str],
    slice_us: int | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Sums over events strictly inside each row's own interval ``(start, end)``; ``measures`` maps names to measures."""
    base = queries if base is None else base
    upto = [Feature(f"__upto_{n}", "sum", m, None, -1) for n, m in measures.items()]
    since = [Feature(f"__from_{n}", "sum", m, None, 0) for n, m in measures.items()]
    got = trailing(queries, keys, end, [stream], upto, slice_us, base)
    got = trailing(got, keys, start, [stream], since, slice_us, base)
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    out = []
    for n in measures:
        inside = F.greatest(F.col(f"__upto_{n}") - F.col(f"__from_{n}"), F.lit(0))
        out.append(F.when(known, F.when(F.col(start) < F.col(end), inside).otherwise(F.lit(0))).alias(n))
    return got.select(*queries.columns, *out)
