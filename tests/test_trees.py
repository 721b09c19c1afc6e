"""Boosted trees against an exhaustive search for splits, many models against one by one, and losses by what they promise."""

import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from eventloom.operators import boost, trees
from eventloom.operators.trees import Settings

ONE = Settings(rounds=1, depth=2, rate=1.0, shrink=0.0, least_rows=5, rows=1.0, inputs=1.0)


@pytest.fixture(scope="module")
def df(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        a, b = rng.choice([None, float(rng.randrange(12))]), rng.uniform(0, 1)
        y = (3.0 if a is None else a) * (2 if b > 0.4 else -1) + rng.gauss(0, 0.3)
        rows.append((i, "abc"[i % 3] if i % 11 else None, a, b, y + (5 if i % 3 == 1 else 0), 1.0, i % 5 == 0))
    return spark.createDataFrame(rows, "id long, e string, a double, b double, y double, base double, held boolean").repartition(4).cache()


def best_split(codes, r, least):
    """(gain, input, code) by trying everything; of equal ones the first."""
    best = (1e-9, -1, 0)
    for f in range(codes.shape[1]):
        for c in range(int(codes[:, f].max())):
            low = codes[:, f] <= c
            if min(low.sum(), (~low).sum()) >= least:
                gain = r[low].sum() ** 2 / low.sum() + r[~low].sum() ** 2 / (~low).sum() - r.sum() ** 2 / len(r)
                if gain > best[0] + 1e-9:
                    best = (gain, f, c)
    return best


def test_one_tree_is_the_best_one(df):
    forest = trees.fit(df, ["a", "b"], F.col("y"), ["all"], F.array(F.lit(0)), settings=ONE, base=F.col("base"))
    pdf = df.toPandas()
    codes = forest.codes([pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)])
    left = pdf["y"].to_numpy() - 1
    assert forest.start[0] == pytest.approx(left.mean())
    r = left - left.mean()
    nodes = [np.arange(len(r))]
    for level in range(2):
        below = []
        for i, rows in enumerate(nodes):
            _, f, c = best_split(codes[rows], r[rows], 5)
            at = (1 << level) - 1 + i
            assert (forest.where[0][0, at], forest.cut[0][0, at]) == (f, c)
            below += [rows[codes[rows, f] <= c], rows[codes[rows, f] > c]]
        nodes = below
    assert forest.leaf[0][0] == pytest.approx([r[rows].mean() for rows in nodes])
    got = {x.id: x.p for x in trees.predict(forest, df, "p").collect()}
    for leaf, rows in zip(forest.leaf[0][0], nodes):
        assert all(got[int(pdf["id"][i])] == pytest.approx(forest.start[0] + leaf) for i in rows)


def test_many_models_equal_separate_ones(df):
    s = Settings(rounds=4, depth=3, least_rows=5)
    several = trees.fit(df, ["a", "b"], F.col("y"), [1, 2], F.array(F.lit(0), F.lit(1)), seeds=[1, 2], settings=s, base=F.col("base"), held=F.col("held"))
    for m, seed in enumerate((1, 2)):
        alone = trees.fit(df, ["a", "b"], F.col("y"), [seed], F.array(F.lit(0)), seeds=[seed], settings=s, base=F.col("base"), held=F.col("held"))
        for r in range(4):
            assert several.where[r][m].tolist() == alone.where[r][0].tolist() and several.cut[r][m].tolist() == alone.cut[r][0].tolist()
            assert several.leaf[r][m] == pytest.approx(alone.leaf[r][0])
        assert several.best[m] == alone.best[0]
    assert not np.array_equal(several.cut[0][0], several.cut[0][1]) or several.leaf[0][0].tolist() != several.leaf[0][1].tolist()
    mean = {r.id: r.p for r in boost.seed_average(df, df, ["a", "b"], "y", "base", [1, 2], "p", "held", s).collect()}
    apart = [{r.id: r.p for r in boost.residual_boost(df, df, ["a", "b"], "y", "base", "p", "held", seed, s).collect()} for seed in (1, 2)]
    assert all(mean[i] == pytest.approx((apart[0][i] + apart[1][i]) / 2) for i in mean)


def test_experts_are_their_entities_models(spark, df):
    """An expert grows as its entity's rows would alone, with cuts from all rows; rows of others and of none have the pooled model."""
    s = Settings(rounds=3, depth=2, least_rows=5, inputs=1.0)
    got = {r.id: r.p for r in boost.entity_experts(df, df, "e", 182, ["a", "b"], "y", "base", "p", "held", s).collect()}
    strong = [r.e for r in df.where("e is not null").groupBy("e").count().where("count >= 182").collect()]
    assert len(got) == 600 and 0 < len(strong) < 3
    pooled = {r.id: r.p for r in boost.residual_boost(df, df, ["a", "b"], "y", "base", "p", "held", settings=s).collect()}
    keep = trees._edges
    edges = keep(df, ["a", "b"], s.bins)
    try:
        trees._edges = lambda *a: edges
        alone = {e: {r.id: r.p for r in boost.residual_boost(df.where(F.col("e") == e), df, ["a", "b"], "y", "base", "p", "held", settings=s).collect()} for e in strong}
    finally:
        trees._edges = keep
    for r in df.collect():
        assert got[r.id] == pytest.approx(alone[r.e][r.id] if r.e in strong else pooled[r.id])


def test_scores_written_between_rounds_change_nothing(df, monkeypatch):
    s = Settings(rounds=5, depth=2, least_rows=5)
    fits = []
    for keep in (25, 2):
        monkeypatch.setattr(trees, "KEEP_ROUNDS", keep)
        fits.append(trees.fit(df, ["a", "b"], F.col("y"), ["all"], F.array(F.lit(0)), settings=s, base=F.col("base"), held=F.col("held")))
    for r in range(5):
        assert fits[0].where[r].tolist() == fits[1].where[r].tolist() and fits[0].leaf[r] == pytest.approx(fits[1].leaf[r])


def test_losses(df):
    held = df.where("held")
    s = Settings(rounds=30, depth=3, rate=0.3, least_rows=10)
    mse = lambda d, p: d.agg(F.avg((F.col(p) - F.col("y")) ** 2)).first()[0]
    got = boost.residual_boost(df, held, ["a", "b"], "y", "base", "p", "held", settings=s)
    assert mse(got, "p") < 0.5 * mse(got.withColumn("m", F.lit(df.agg(F.avg("y")).first()[0])), "m")
    # the quantile has about as many rows below it
    got = boost.residual_boost(df, df, ["a", "b"], "y", "base", "p", "held", settings=Settings(rounds=20, depth=2, rate=0.3, least_rows=20, loss="quantile", at=0.8))
    assert 0.74 < got.agg(F.avg((F.col("y") <= F.col("p")).cast("double"))).first()[0] < 0.86
    # far values pull a squared loss more than a Huber one
    far = df.withColumn("y", F.when(F.col("id") % 50 == 0, 1e4).otherwise(F.col("y")))
    off = [boost.residual_boost(far, held, ["a", "b"], "y", "base", "p", settings=Settings(rounds=12, depth=2, rate=0.3, loss=k, at=5.0)) for k in ("squared", "huber")]
    usual = [g.where("id % 50 <> 0").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0] for g in off]
    assert usual[1] < usual[0]
    p = boost.tail_probability(df, df, ["a", "b"], F.col("y") > 8, "p", "held", Settings(rounds=20, depth=3, rate=0.3, least_rows=5))
    share = {r.t: r.p for r in p.groupBy((F.col("y") > 8).alias("t")).agg(F.avg("p").alias("p")).collect()}
    assert 0 < share[False] < 0.35 < 0.65 < share[True] < 1


def test_early_stopping_and_importance(spark, df):
    noise = df.withColumn("y", F.rand(3)).cache()
    forest = trees.fit(noise, ["a", "b"], F.col("y"), ["all"], F.array(F.lit(0)), settings=Settings(rounds=60, depth=3, rate=0.5, least_rows=5, patience=3), held=F.col("held"))
    assert len(forest.leaf) < 60 and forest.best[0] <= len(forest.leaf) - 3
    shares = {f: x for f, _, x in boost.importance(df, ["a", "b", "base"], "y", "base", {}, settings=Settings(rounds=2, depth=2))}
    assert sum(shares.values()) == pytest.approx(1) and shares["base"] == 0 and shares["a"] > 0.2
    assert math.isfinite(forest.start[0])


def test_nothing_to_learn_from(spark, df):
    got = boost.residual_boost(df.where("false"), df, ["a", "b"], "y", "base", "p", "held", settings=Settings(rounds=2, depth=2))
    assert got.where("p <> base").count() == 0 and got.count() == 600


def test_blocks_are_written_in_row_groups_that_a_reader_can_hold(spark, monkeypatch):
    """A reader takes a whole row group at once, and a block is a row, so the writer must look at sizes long before its hundredth row."""
    files, write = [], trees.written

    def kept(*args, **kw):
        out = write(*args, **kw)
        files.extend(out.inputFiles())
        return out

    monkeypatch.setattr(trees, "written", kept)
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 1)
    rows = spark.range(0, 1_000_000, 1, 1).select(F.rand(1).alias("a"), F.rand(2).alias("y"))
    forest = trees.fit(rows, ["a"], F.col("y"), ["all"], F.array(F.lit(0)), settings=Settings(rounds=2, depth=1))
    assert len(forest.leaf) == 2
    groups = [pq.read_metadata(f.removeprefix("file://")) for f in files]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    # the blocks, and those of the second round; before 19 MB a row group each time
    assert len(files) >= 2 and sum(sizes) > 30 << 20
    assert max(sizes) <= 16 << 20


def test_rows_of_a_round_stay_out_of_the_heap(df, monkeypatch):
    """Serialised blocks of a large table fill an executor's heap, whose regions they fit badly."""
    levels, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, level: levels.append(level) or persist(self, level))
    trees.fit(df, ["a", "b"], F.col("y"), ["all"], F.array(F.lit(0)), settings=Settings(rounds=2, depth=1))
    assert len(levels) == 4 and all(x.useDisk and not x.useMemory for x in levels)


def test_blocks_of_stopped_models_are_left_out_when_written_again(spark):
    """A block whose models have all stopped has no rows left."""
    block = lambda n: {"codes": np.ones((n, 2), np.uint8)} | {c: np.ones(n, k) for c, k in trees._KINDS.items()}
    got = trees._rescored(spark, spark.sparkContext.parallelize([block(0), block(3)], 1)).collect()
    assert [b["codes"].tolist() for b in got] == [[[1, 1]] * 3] and got[0]["score"].tolist() == [1.0] * 3
