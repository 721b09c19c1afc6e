"""Regimes: k-means for several numbers of clusters and several starts in the same scans, chosen by the exact silhouette.

All sets of centres move together: a scan assigns each row once for every set and adds up rows by (set, cluster), so the number of
jobs is that of the rounds. The silhouette (squared Euclidean distances) needs no pairs: a row's mean distance to a cluster follows
from the cluster's size, sum and sum of squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.sources.scratch import written


@dataclass
class Regimes:
    """Centres for standardised features, with each number of clusters' silhouette and the within-cluster sum of squares."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    centres: np.ndarray
    silhouettes: dict[int, float]
    inertia: dict[int, float]

    def assign(self, x: np.ndarray) -> np.ndarray:
        return _nearest((x - self.mean) / self.scale, self.centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equally near ones the first."""
    return ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    return pdf[features].to_numpy(np.float64)


def _clean(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as numbers; what is missing or not finite counts as 0."""
    c = {f: F.col(f).cast("double") for f in features}
    return df.withColumns({f: F.when(F.abs(c[f]) < float("inf"), c[f]).otherwise(F.lit(0.0)) for f in features})


def cluster_sums(df: DataFrame, sets: list[str], features: list[str]) -> DataFrame:
    """(set, cluster, n, squares, sums): each cluster's size, sum of squared norms and sums of features, for each of the columns ``sets``."""
    x = _clean(df, features)
    squares = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    marked = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), F.col(s).cast("string").alias("cluster")) for s in sets]))
    rows = x.select(marked.alias("_m"), squares.alias("_squares"), *features).where("_m.cluster is not null")
    sums = rows.groupBy("_m.set", "_m.cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("_squares").alias("squares"), F.array(*[F.sum(f) for f in features]).alias("sums"))
    return sums.select("set", "cluster", "n", "squares", "sums")


def silhouettes(df: DataFrame, sets: list[str], features: list[str]) -> DataFrame:
    """(set, silhouette) of the clusterings in the columns ``sets``: the mean over rows of (b - a) / max(a, b), with a the mean squared distance to
    the other rows of a row's cluster and b the least mean squared distance to another cluster's rows.

    A row alone in its cluster counts 0, rows without a cluster nothing; a clustering of one cluster has null. Exact, in two scans: the
    first adds up clusters, of which there are few, the second compares every row with them.
    """
    sums = cluster_sums(df, sets, features).groupBy("set").agg(F.collect_list(F.struct("cluster", "n", "squares", "sums")).alias("_clusters"))
    x = _clean(df, features)
    marked = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), F.col(s).cast("string").alias("cluster")) for s in sets]))
    vector = F.array(*[F.col(f) for f in features])
    norm = sum((F.col(f) * F.col(f) for f in features), F.lit(0.0))
    rows = x.select(marked.alias("_m"), vector.alias("_x"), norm.alias("_norm")).select("_m.set", "_m.cluster", "_x", "_norm").where("cluster is not null").join(F.broadcast(sums), "set")
    dot = lambda c: F.aggregate(F.zip_with("_x", c["sums"], lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    total = lambda c: F.greatest(F.col("_norm") * c["n"] + c["squares"] - 2 * dot(c), F.lit(0.0))
    mine = F.filter("_clusters", lambda c: c["cluster"] == F.col("cluster"))[0]
    rows = rows.withColumn("_own", mine).withColumn("_others", F.filter("_clusters", lambda c: c["cluster"] != F.col("cluster")))
    near = rows.withColumn("_a", total(F.col("_own")) / F.nullif(F.col("_own.n") - 1, F.lit(0))).withColumn("_b", F.array_min(F.transform("_others", lambda c: total(c) / c["n"])))
    score = F.when(F.col("_a").isNull() & F.col("_b").isNotNull(), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / F.nullif(F.greatest("_a", "_b"), F.lit(0.0)))
    score = F.when((F.col("_a") == 0) & (F.col("_b") == 0), F.lit(0.0)).otherwise(score)
    return near.groupBy("set").agg(F.avg(score).alias("silhouette"))


def fit(df: DataFrame, features: list[str], ks: list[int], starts: int = 5, rounds: int = 50, seed: int = 1) -> Regimes:
    """Fit every number of clusters in ``ks`` from several starts, and keep the number with the best silhouette.

    A start's centres are the rows with the smallest hashes of their features and the start's number, each different from the others. All
    starts of all numbers move in the same scans until no centre moves.
    """
    spark = df.sparkSession
    x = written(_clean(df, features).select(*features), "states")
    stats = x.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(len(features))])
    scale = np.array([stats[f"s{i}"] or 0.0 for i in range(len(features))])
    scale[scale == 0] = 1.0
    sets: dict[tuple[int, int], np.ndarray] = {}
    for s in range(starts):
        drawn = x.distinct().orderBy(F.xxhash64(F.lit(seed), F.lit(s), *features), *features).limit(max(ks)).collect()
        for k in ks:
            sets[k, s] = (np.array([list(r) for r in drawn[:k]], np.float64).reshape(-1, len(features)) - mean) / scale
    names = list(sets)
    inertia = np.zeros(len(names))
    for _ in range(rounds):
        send = spark.sparkContext.broadcast([sets[n] for n in names])

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros((len(c), len(features) + 2)) for c in send.value]
            for pdf in batches:
                z = (_matrix(pdf, features) - mean) / scale
                row = np.concatenate((np.ones((len(z), 1)), z, np.zeros((len(z), 1))), 1)
                for t, centres in zip(total, send.value):
                    if len(centres):
                        own = _nearest(z, centres)
                        row[:, -1] = ((z - centres[own]) ** 2).sum(1)
                        np.add.at(t, own, row)
            yield pd.DataFrame([(i, j, r.tolist()) for i, t in enumerate(total) for j, r in enumerate(t)], columns=["_set", "_cluster", "_sums"])

        parts = x.mapInPandas(add, "_set int, _cluster int, _sums array<double>").select("_set", "_cluster", *[F.col("_sums")[i].alias(f"_{i}") for i in range(len(features) + 2)])
        moved = False
        inertia[:] = 0
        for r in parts.groupBy("_set", "_cluster").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(len(features) + 2)]).collect():  # a row for each centre
            centre, n = sets[names[r["_set"]]][r["_cluster"]], r["_0"]
            inertia[r["_set"]] += r[f"_{len(features) + 1}"]
            if n:  # a centre without rows stays where it is
                new = np.array([r[f"_{i + 1}"] for i in range(len(features))]) / n
                moved |= not np.allclose(new, centre, rtol=0, atol=1e-9)
                centre[:] = new
        send.destroy()
        if not moved:
            break
    best = {k: min((inertia[i], n[1]) for i, n in enumerate(names) if n[0] == k) for k in ks}
    chosen = {k: sets[k, best[k][1]] for k in ks}
    numbers = [F.col(f) for f in features]

    @F.pandas_udf("array<int>")
    def clusters(columns: pd.DataFrame) -> pd.Series:
        z = (columns.to_numpy(np.float64) - mean) / scale
        return pd.Series(list(np.stack([_nearest(z, chosen[k]) for k in ks], 1).astype(np.int32)))

    scaled = x.withColumn("_c", clusters(F.struct(*numbers))).select(*[((F.col(f) - float(m)) / float(s)).alias(f) for f, m, s in zip(features, mean, scale)], *[F.col("_c")[i].alias(f"k{k}") for i, k in enumerate(ks)])
    found = {r["set"]: r["silhouette"] for r in silhouettes(scaled, [f"k{k}" for k in ks], features).collect()}
    scores = {k: found.get(f"k{k}") if found.get(f"k{k}") is not None else -1.0 for k in ks}
    win = max(ks, key=lambda k: (scores[k], -k))
    order = np.lexsort(chosen[win].T[::-1])  # numbered by their centres, so a run's numbers mean the same
    return Regimes(features, mean, scale, chosen[win][order], scores, {k: float(best[k][0]) for k in ks})


def assign(model: Regimes, df: DataFrame, name: str) -> DataFrame:
    """Append the regime of every row."""
    @F.pandas_udf("int")
    def regime(columns: pd.DataFrame) -> pd.Series:
        return pd.Series(model.assign(columns.to_numpy(np.float64)).astype(np.int32))

    finite = lambda f: F.when(F.abs(F.col(f).cast("double")) < float("inf"), F.col(f).cast("double")).otherwise(F.lit(0.0)).alias(f)
    return df.withColumn(name, regime(F.struct(*[finite(f) for f in model.features])))
