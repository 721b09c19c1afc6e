"""Order statistics of moving time frames, and the mix of resources in them, without a list per row.

Quantiles of row ranges come from a wavelet matrix: values become codes, and from the highest bit of the codes to the lowest the
rows are parted by that bit, keeping their order. How many rows of a range have a 0 there is a difference of two prefix counts, so
each level either keeps a range's zeros or its ones and halves the codes in question: any quantile of any range takes one step a
bit, however long the range. All ranges of a slice take a level's step together, and only one level is held. Sums come from prefix
sums. A slice has the rows of its frames: they are copied once, and a frame must fit a task.

The mix of resources needs no frame at all: an event enters and leaves, so what is inside is a running count for each resource, whose
value at a slice's border is carried over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.slices import slice_width, solid_keys, time_slice


def ranks_in_ranges(values: np.ndarray, begin: np.ndarray, end: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The value of the given rank (from 0) among ``values[begin:end]``, for many ranges, none of them empty."""
    if not len(begin):
        return np.zeros(0, values.dtype)
    distinct, code = np.unique(values, return_inverse=True)
    begin, end, rank, found = begin.copy(), end.copy(), rank.copy(), np.zeros(len(begin), np.int64)
    for level in reversed(range(int(len(distinct) - 1).bit_length())):
        one = (code >> level) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        low, high = zeros[begin], zeros[end]
        up = rank >= high - low
        rank -= np.where(up, high - low, 0)
        begin = np.where(up, zeros[-1] + begin - low, low)
        end = np.where(up, zeros[-1] + end - high, high)
        found |= up.astype(np.int64) << level
        code = np.concatenate((code[one == 0], code[one == 1]))
    return distinct[found]


def _quantile(values: np.ndarray, begin: np.ndarray, end: np.ndarray, q: float, nearest: bool) -> np.ndarray:
    """Interpolated or nearest quantile of ranges that are not empty."""
    at = (end - begin - 1) * q
    if nearest:
        return ranks_in_ranges(values, begin, end, np.floor(at + 0.5).astype(np.int64))
    low = np.floor(at).astype(np.int64)
    both = ranks_in_ranges(values, np.tile(begin, 2), np.tile(end, 2), np.concatenate((low, np.ceil(at).astype(np.int64))))
    return both[: len(at)] + (both[len(at) :] - both[: len(at)]) * (at - low)


def _spread(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sample standard deviation of ranges, nan below two values; exact sums where the values are whole numbers of moderate size."""
    n, centre = end - begin, np.round(np.median(values))
    off = values - centre
    top = float(np.abs(off).max(initial=0))
    whole = bool((off == np.floor(off)).all()) and top * top * len(off) < 2**62
    off = off.astype(np.int64) if whole else off.astype(np.longdouble)
    sums = [np.concatenate((np.zeros(1, off.dtype), np.cumsum(x))) for x in (off, off * off)]
    one, two = (s[end] - s[begin] for s in sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt(np.maximum(n * two.astype(np.longdouble) - one.astype(np.longdouble) ** 2, 0) / (n * (n - 1.0)))
    if not whole:  # what rounding leaves of a constant
        last = np.concatenate((np.flatnonzero(np.diff(values)), [len(values) - 1]))
        out[(n > 1) & (last[np.searchsorted(last, begin)] >= end - 1)] = 0
    out[n < 2] = np.nan
    return out.astype(np.float64)


def _statistic(values: np.ndarray, begin: np.ndarray, end: np.ndarray, stat: str) -> np.ndarray:
    """``mean``, ``std``, ``med``, ``p<n>`` (interpolated) or ``near<n>`` (nearest rank) of ranges; nan where there is none."""
    out = np.full(len(begin), np.nan)
    full = end > begin
    if not full.any():
        return out
    begin, end = begin[full], end[full]
    if stat == "mean":
        total = np.concatenate(([0], np.cumsum(values.astype(np.longdouble))))
        out[full] = ((total[end] - total[begin]).astype(np.float64)) / (end - begin)
    elif stat == "std":
        out[full] = _spread(values, begin, end)
    else:
        q = 0.5 if stat == "med" else float(stat.lstrip("pnear")) / 100
        out[full] = _quantile(values, begin, end, q, stat.startswith("near"))
    return out


def frame_statistics(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    frames: dict[str, tuple[str, int, str]],
    peers: bool = False,
    slice_us: int | None = None,
) -> DataFrame:
    """Append statistics of a value over the frame ``(t - width, t]``: ``frames`` maps names to (value, width, statistic).

    Statistics are mean, std, med, p<n> (interpolated) and near<n> (nearest rank). The frame ends with the row itself, or with
    ``peers`` takes rows of the same time that come later in ``order`` in. Null and nan values are left out; an empty frame has null.
    All rows come back: a null key is a key of its own, and rows without a time have null and are in no frame.
    """
    reach = max(width for _, width, _ in frames.values())
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in frames])
    rows_wide = F.lit(slice_us) if slice_us else slice_width([(df, order[0])])
    width = F.greatest(F.lit(reach), rows_wide)
    rows, ks = solid_keys(df, keys, order[0])
    at = F.col(order[0])
    rows = rows.withColumn("_home", F.coalesce(time_slice(at, width), F.lit(0)))
    copies = F.when(at + F.lit(reach) > (F.col("_home") + 1) * width, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    rows = rows.withColumn("_slice", F.explode(copies)).select(*names, *ks, (F.col("_home") == F.col("_slice")).alias("_own"), "_slice")

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        own = table["_own"].to_numpy()
        out = table.select(names).filter(table["_own"])
        if table[order[0]].null_count:  # the group of rows without a time
            for n in frames:
                out = out.append_column(n, pa.nulls(len(out), pa.float64()))
            return out
        times = table[order[0]].to_numpy()
        asked = times[own]
        for n, (value, wide, stat) in frames.items():
            x = table[value].cast(pa.float64()).to_numpy(zero_copy_only=False)
            known = ~np.isnan(x)
            had = np.cumsum(known)[own]
            x, t = x[known], times[known]
            begin = np.searchsorted(t, asked - wide, "right")
            end = np.searchsorted(t, asked, "right") if peers else had
            got = _statistic(x, np.minimum(begin, end), end, stat)
            out = out.append_column(n, pa.array(got, mask=np.isnan(got)))
        return out

    return rows.groupBy(*ks, "_slice").applyInArrow(work, schema)


def mix(df: DataFrame, keys: list[str], at: str, resource: str, width: int, slice_us: int | None = None) -> DataFrame:
    """Append what the events of ``[t - width, t)`` are of: ``n``, ``top`` (the most frequent resource's events), ``dominant`` (it; of
    several the smallest) and ``entropy`` (natural logarithm; null in an empty frame).

    Each event is a plus for its resource when it enters and a minus when it leaves; counts at slice borders are carried over, so the
    width of the frame costs nothing. Null resources are left out. All rows come back; a null key is a key of its own, and a row
    without a time has null and is no event.
    """
    solid, ks = solid_keys(df, keys, at)
    wide = F.lit(slice_us) if slice_us else slice_width([(df, at)])
    events = solid.where(F.col(at).isNotNull() & F.col(resource).isNotNull())
    moments = F.inline(F.array(*[F.struct((F.col(at) + F.lit(o)).alias("_t"), F.lit(d).alias("_d")) for o, d in ((1, 1), (width + 1, -1))]))
    changes = events.select(*ks, F.col(resource).alias("_r"), moments).groupBy(*ks, "_t", "_r").agg(F.sum("_d").alias("_d"))
    changes = changes.withColumn("_slice", time_slice(F.col("_t"), wide))
    along = Window.partitionBy(*ks, "_r").orderBy("_slice")
    totals = changes.groupBy(*ks, "_r", "_slice").agg(F.sum("_d").alias("_d"))
    carried = totals.select(*ks, "_r", "_slice", F.sum("_d").over(along).alias("_d"), F.lead("_slice").over(along).alias("_next")).where("_d != 0")
    # nothing is left inside after the last change, so there is a next one
    borders = carried.select(*ks, "_r", "_d", F.explode(F.sequence(F.col("_slice") + 1, F.col("_next"))).alias("_slice"))
    borders = borders.withColumn("_t", F.col("_slice") * wide)
    asked = solid.where(F.col(at).isNotNull()).select(*ks, F.col(at).alias("_t")).distinct().withColumn("_slice", time_slice(F.col("_t"), wide))
    columns = (*ks, "_slice", "_t", "_r", "_d")
    line = changes.select(*columns).union(borders.select(*columns))
    line = line.union(asked.select(*ks, "_slice", "_t", F.lit(None).alias("_r"), F.lit(None).cast("bigint").alias("_d")))
    kinds = {f.name: f.dataType.simpleString() for f in line.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*ks, "_t")) + f", n bigint, top bigint, dominant {kinds['_r']}, entropy double"

    def work(table: pa.Table) -> pa.Table:
        query = table["_d"].is_null()
        asked = table.filter(query).select([*ks, "_t"])
        change = table.filter(pc.invert(query)).sort_by("_t")
        t, when, delta = asked["_t"].to_numpy(), change["_t"].to_numpy(), change["_d"].to_numpy()
        coded = change["_r"].combine_chunks().dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        n, top, best, logs = (np.zeros(len(t), k) for k in (np.int64, np.int64, np.int64, np.float64))
        by_name = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by_name], np.arange(len(names) + 1))
        for i in sorted(range(len(names)), key=names.__getitem__):
            mine = by_name[cuts[i] : cuts[i + 1]]
            inside = np.concatenate(([0], np.cumsum(delta[mine])))[np.searchsorted(when[mine], t, "right")]
            more = inside > top
            top[more], best[more] = inside[more], i
            n += inside
            logs += inside * np.log(np.maximum(inside, 1))
        some = n > 0
        entropy = np.maximum(np.log(np.maximum(n, 1)) - logs / np.maximum(n, 1), 0)
        dominant = pa.array([names[i] if s else None for i, s in zip(best, some)], table.schema.field("_r").type)
        for c, x in (("n", pa.array(n)), ("top", pa.array(top)), ("dominant", dominant), ("entropy", pa.array(entropy, mask=~some))):
            asked = asked.append_column(c, x)
        return asked

    got = line.groupBy(*ks, "_slice").applyInArrow(work, schema).withColumnRenamed("_t", "_at")
    joined = solid.join(got, [solid[k] == got[k] for k in ks] + [solid[at] == got["_at"]], "left")
    return joined.select(*[solid[c] for c in df.columns], "n", "top", "dominant", "entropy")
