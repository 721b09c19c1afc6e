"""Monotone calibration of a score, for any number of groups at once, by pools that merge.

Pooling adjacent violators may start anywhere: points of a slice of scores are pooled first, and the pools of a group's slices are
pooled again, which gives what pooling all of its points would. Slices bound what a task sorts; a group's pools, at most as many as it
has different scores and usually very few, meet in one task of four numbers each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.slices import Running, running, solid_keys, value_slice


def pooled(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Where pools begin: neighbours are merged until their means no longer fall."""
    begin, sums, weights = [], [], []
    for i, (s, w) in enumerate(zip(total.tolist(), weight.tolist())):
        begin.append(i)
        sums.append(s)
        weights.append(w)
        # an equal mean is one pool as well
        while len(sums) > 1 and sums[-2] * weights[-1] >= sums[-1] * weights[-2]:
            s, w = sums.pop(), weights.pop()
            begin.pop()
            sums[-1] += s
            weights[-1] += w
    return np.array(begin, np.int64)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pools of pools, which lie side by side."""
    pdf = pdf.sort_values("_lo", kind="stable")
    total, weight = pdf["_total"].to_numpy(), pdf["_weight"].to_numpy()
    begin = pooled(total, weight)
    out = pdf.iloc[begin].copy()
    out["_hi"] = pdf["_hi"].to_numpy()[np.append(begin[1:], len(pdf)) - 1]
    out["_total"], out["_weight"] = np.add.reduceat(total, begin), np.add.reduceat(weight, begin)
    return out


def _usable(c: str | Column) -> Column:
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return c.isNotNull() & (F.abs(c) < float("inf"))


def pools(train: DataFrame, keys: list[str], x: str, y: str, weight: Column | None = None) -> DataFrame:
    """(keys, _lo, _hi, _total, _weight): the steps of the monotone fit of ``y`` on ``x`` for each group; a null key is a group of its own.

    Rows whose x or y is null or not finite play no part; rows of one x are one point.
    """
    rows, solid = solid_keys(train.where(_usable(x) & _usable(y)).withColumn("_one", F.lit(1.0) if weight is None else weight.cast("double")), keys)
    at = F.col(x).cast("double") + F.lit(0.0)  # one zero
    points = rows.groupBy(*keys, *solid, at.alias("_lo")).agg(F.sum(F.col(y) * F.col("_one")).cast("double").alias("_total"), F.sum("_one").alias("_weight")).where("_weight > 0")
    points = points.select(*keys, *solid, "_lo", F.col("_lo").alias("_hi"), "_total", "_weight")
    schema = points.schema
    parts = points.withColumn("_slice", value_slice(F.col("_lo"))).groupBy(*solid, "_slice").applyInPandas(lambda pdf: _merge(pdf.drop(columns="_slice")), schema)
    return parts.groupBy(*solid).applyInPandas(_merge, schema).select(*keys, "_lo", "_hi", "_total", "_weight")


def isotonic(train: DataFrame, apply_to: DataFrame, x: str, y: str, name: str, keys: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """Append the monotone fit of ``y`` at ``x``: a step's mean inside it, straight lines between steps, the outer steps beyond.

    With ``keys`` each group has a fit of its own. A row without a finite x, or of a group that nothing was learnt for, gets null.
    """
    keys = keys or []
    steps = pools(train, keys, x, y, weight)
    value = F.col("_total") / F.col("_weight")
    ends = steps.select(*keys, F.inline(F.array(F.struct(F.col("_lo").alias("_x"), value.alias("_v")), F.struct(F.col("_hi").alias("_x"), value.alias("_v"))))).distinct()
    at = F.when(_usable(x), F.col(x).cast("double") + F.lit(0.0))
    asked, solid = solid_keys(apply_to.withColumn("_x", at), keys)
    ends, _ = solid_keys(ends, keys)
    line = ends.select(*solid, "_x", "_v", F.lit(0).alias("_q")).union(asked.where("_x is not null").select(*solid, "_x", F.lit(None).cast("double"), F.lit(1)).distinct())
    mark = F.when(F.col("_q") == 0, F.struct("_x", "_v"))
    line = line.withColumn("_up", value_slice(F.col("_x"))).withColumn("_down", -F.col("_up")).withColumn("_minus", -F.col("_x"))
    line = running(line, solid, ["_x", "_q"], "_up", [Running("_below", "last", mark, 0)], solid=True)
    line = running(line, solid, ["_minus", "_q"], "_down", [Running("_above", "last", mark, 0)], solid=True)
    low, high = F.col("_below"), F.col("_above")
    between = low["_v"] + (F.col("_x") - low["_x"]) / F.nullif(high["_x"] - low["_x"], F.lit(0.0)) * (high["_v"] - low["_v"])
    fitted = F.when(low.isNull(), high["_v"]).when(high.isNull() | (low["_v"] == high["_v"]), low["_v"]).otherwise(F.coalesce(between, low["_v"]))
    table = line.where("_q = 1").select(*solid, "_x", fitted.alias(name))
    return asked.join(table, [*solid, "_x"], "left").select(*apply_to.columns, name)
