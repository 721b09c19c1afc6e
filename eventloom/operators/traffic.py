"""Traffic, occupancy, disruption and service features built from the timeline and row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.arrays import array_quantile, array_sum
from eventloom.functions.clock import SECOND, whole_div
from eventloom.operators.asof import asof, next_after
from eventloom.operators.ranks import quantiles
from eventloom.operators.rolling import frame_statistics, mix
from eventloom.operators.rowframes import over_rows
from eventloom.operators.scan import since_change
from eventloom.operators.timeline import Feature, Stream, before, between_open, events, trailing, until


def occupancy(
    df: DataFrame, keys: list[str], at: str, source: DataFrame, start: str, end: str, name: str,
    source_keys: list[str] | None = None, through_now: bool = False, own: int = 0, only: Column | None = None,
    base: DataFrame | None = None,
) -> DataFrame:
    """Intervals started but not ended at each query time, as a count difference.

    ``through_now`` counts starts and ends at the query time itself; ``own`` is taken off and the result
    is kept at or above zero when it is set.
    """
    sk = source_keys or keys
    hi = 0 if through_now else -1
    weight = F.lit(1) if only is None else F.when(only, F.lit(1))
    begun = Stream(source, sk, start, {"_begun": weight})
    done = Stream(source.where(F.col(start).isNotNull()), sk, end, {"_done": weight})
    got = trailing(df, keys, at, [begun, done], [Feature("__started", "sum", "_begun", None, hi), Feature("__ended", "sum", "_done", None, hi)], base=base)
    level = F.col("__started") - F.col("__ended") - F.lit(own)
    return got.withColumn(name, F.greatest(level, F.lit(0)) if own else level).drop("__started", "__ended")


def surface_counts(
    df: DataFrame, keys: list[str], at: str, streams: dict[str, DataFrame], widths: dict[str, int], since: bool = True,
    base: DataFrame | None = None,
) -> DataFrame:
    """Counts strictly before t per stream and width, and seconds since each stream's last event.

    All streams and widths of one key share a single timeline. Columns are ``<stream>_<width>`` and
    ``<stream>_since``.
    """
    sources, features = [], []
    for s, source in streams.items():
        sources.append(events(source, keys, at, **{f"_n_{s}": F.lit(1), f"_t_{s}": F.col(at)}))
        features += [before(f"{s}_{w}", "sum", f"_n_{s}", us) for w, us in widths.items()]
        if since:
            features.append(before(f"_last_{s}", "max", f"_t_{s}", None))
    got = trailing(df, keys, at, sources, features, base=base)
    for s in streams:
        if since:
            got = got.withColumn(f"{s}_since", ((F.col(at) - F.col(f"_last_{s}")) / F.lit(SECOND)).cast("double")).drop(f"_last_{s}")
    return got


def delay_state(
    df: DataFrame, keys: list[str], at: str, source: DataFrame, source_at: str, value: str, widths: dict[str, int],
    thresholds: dict[str, float], prefix: str, own_at: str | None = None, own_value: str | None = None,
) -> DataFrame:
    """Count, mean and shares above thresholds of a value over events in ``(t - w, t]``.

    With ``own_at`` / ``own_value`` the row's own event, which may lie at another clock than the query,
    is taken out where it falls inside the window.
    """
    v = F.col(value)
    measures = {"_n": F.when(v.isNotNull(), 1), "_s": v} | {f"_x{k}": F.when(v > x, 1) for k, x in thresholds.items()}
    features = [until(f"{m}_{w}", "sum", m, us) for w, us in widths.items() for m in measures]
    got = trailing(df, keys, at, [Stream(source, keys, source_at, measures)], features)
    cols = []
    for w, us in widths.items():
        inside = F.lit(False)
        if own_at:
            inside = F.coalesce(
                (F.col(own_at) <= F.col(at)) & (F.col(own_at) > F.col(at) - F.lit(us)) & F.col(own_value).isNotNull(), F.lit(False)
            )
        own = F.when(inside, F.lit(1)).otherwise(F.lit(0))
        n = F.col(f"_n_{w}") - own
        total = F.col(f"_s_{w}") - F.when(inside, F.col(own_value)).otherwise(F.lit(0.0)) if own_at else F.col(f"_s_{w}")
        cols += [n.alias(f"{prefix}_n_{w}"), F.when(n > 0, total / n).alias(f"{prefix}_mean_{w}")]
        for k, x in thresholds.items():
            above = F.col(f"_x{k}_{w}")
            if own_at:
                above = above - F.when(inside & (F.col(own_value) > F.lit(x)), F.lit(1)).otherwise(F.lit(0))
            cols.append(F.when(n > 0, above / n).alias(f"{prefix}_over{k}_{w}"))
    return got.select(*df.columns, *cols)


def window_quantiles_asof(
    df: DataFrame, source: DataFrame, keys: list[str], at: str, source_at: str, value: str, width: int, prefix: str
) -> DataFrame:
    """Median, p75 and p90 of the window ``(s - w, s]`` at the last source event at or before t."""
    kept = source.where(F.col(value).isNotNull() & F.col(source_at).isNotNull()).select(*keys, source_at, F.col(value).cast("double").alias("_v"))
    stats = frame_statistics(kept, keys, [source_at], {"_med": ("_v", width, "med"), "_p75": ("_v", width, "near75"), "_p90": ("_v", width, "near90")}, peers=True)
    return asof(df, stats, keys, at, source_at, {f"{prefix}_med": "_med", f"{prefix}_p75": "_p75", f"{prefix}_p90": "_p90"}, tie="_med")


def headway_service(df: DataFrame, keys: list[str], order: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """Seconds since the previous row of the key, its median over the last k rows, service rates and slowdown.

    The slowdown compares the 10-row median with the mean headway of all earlier rows, so it never
    looks ahead.
    """
    with_gap = over_rows(df, keys, order, 1, {"headway": lambda r: (F.col(order[0]) - r.lag(order[0])) / F.lit(SECOND)})
    meds = over_rows(
        with_gap, keys, order, max(sizes),
        {f"headway_med{k}": (lambda r, k=k: F.percentile("headway", 0.5).over(r(-k + 1, 0))) for k in sizes},
        base=df,
    )
    for k in sizes:
        meds = meds.withColumn(f"rate{k}", F.lit(60.0) / F.greatest(F.col(f"headway_med{k}"), F.lit(1.0)))
    return meds


def headway_excess(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Predicted headway (median of the last five), observed over predicted, and excess over the last three."""
    gaps = over_rows(df, keys, order, 1, {"headway": lambda r: (F.col(order[0]) - r.lag(order[0])) / F.lit(SECOND)})
    lists = over_rows(
        gaps, keys, order, 5,
        {"_five": lambda r: F.collect_list("headway").over(r(-4, 0)), "_three": lambda r: F.collect_list("headway").over(r(-2, 0))},
        base=df,
    )
    pred = array_quantile(F.col("_five"), 0.5)
    mid = array_quantile(F.col("_three"), 0.5)
    usable = F.col("headway").isNotNull() & (pred > 1)
    excess = F.transform("_three", lambda x: x - mid)
    return lists.select(
        *gaps.columns,
        pred.alias("headway_pred"),
        F.when(usable, F.col("headway") / pred).alias("observed_over_pred"),
        F.when(usable, array_sum(excess)).alias("excess_sum3"),
        F.when(usable, F.array_max(F.transform(excess, lambda x: F.abs(x)))).alias("excess_max3"),
    )


def configuration(df: DataFrame, keys: list[str], at: str, tie: str, resource: str, width: int) -> DataFrame:
    """Which resource dominates the events of ``[t - w, t)``: share, entropy, is-dominant flag, age of the state."""
    got = mix(df, keys, at, resource, width)
    got = got.select(
        *df.columns,
        F.coalesce("n", F.lit(0)).alias("recent"),
        F.when(F.col("n") > 0, F.col("top") / F.col("n")).alias("dominant_share"),
        F.col("entropy").alias("dominant_entropy"),
        "dominant",
        F.coalesce(F.col("dominant") == F.col(resource), F.lit(False)).alias("is_dominant"),
    )
    return since_change(got, keys, [at, tie], F.col("dominant"), "state_age_us")


def release_bounds(
    df: DataFrame, keys: list[str], start: str, end: str, out_source: DataFrame, out_at: str, in_source: DataFrame, in_at: str
) -> DataFrame:
    """Events of two streams strictly inside each row's interval: counts, the first one, and the bounds it sets."""
    outs = out_source.where(F.col(out_at).isNotNull()).select(*keys, F.col(out_at).alias("_at"), F.lit(1).alias("_o"), F.lit(0).alias("_i"))
    ins = in_source.where(F.col(in_at).isNotNull()).select(*keys, F.col(in_at).alias("_at"), F.lit(0).alias("_o"), F.lit(1).alias("_i"))
    both = outs.unionByName(ins)
    stream = events(both, keys, "_at", _o="_o", _i="_i")
    got = between_open(df, keys, start, end, stream, {"n_out": "_o", "n_in": "_i"})
    got = next_after(got, both, keys, start, "_at", "_next", base=df)
    first = F.when((F.col("_next") < F.col(end)), F.col("_next"))
    length = F.greatest((F.col(end) - F.col(start)) / F.lit(SECOND), F.lit(0.0))
    return got.select(
        *df.columns,
        "n_out",
        "n_in",
        first.isNotNull().alias("has_first"),
        F.coalesce((first - F.col(start)) / F.lit(SECOND), length).alias("first_after_start"),
        F.coalesce((F.col(end) - first) / F.lit(SECOND), F.lit(0.0)).alias("first_before_end"),
        F.hour(F.timestamp_micros(F.coalesce(first, F.col(end)))).alias("first_hour"),
    )


def binned_state(
    df: DataFrame, keys: list[str], at: str, bin_us: int, width: int, counts: dict[str, Stream], value: str
) -> DataFrame:
    """Dense time bins per key: stream counts over ``[start - w, start)`` and the median of a value there.

    Bins run from the first to the last event of the key. Counts come from the timeline; a row reaches
    only the few bins that look back on it, so medians group bounded sets.
    """
    own_bin = whole_div(F.col(at), bin_us)
    span = df.groupBy(*keys).agg(F.min(own_bin).alias("_lo"), F.max(own_bin).alias("_hi"))
    bins = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("bin")).withColumn("_at", F.col("bin") * F.lit(bin_us))
    got = trailing(bins, keys, "_at", list(counts.values()), [before(n, "sum", n, width) for n in counts])
    reach = F.sequence(own_bin + 1, whole_div(F.col(at) + F.lit(width), bin_us))
    seen = df.where(F.col(value).isNotNull()).select(*keys, F.explode(reach).alias("bin"), F.col(value).alias("_v"))
    med = quantiles(seen, [*keys, "bin"], "_v", {"median": 0.5})
    return got.drop("_at").join(med, [*keys, "bin"], "left")

