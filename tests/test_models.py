import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from eventloom.operators import boost, calib, history, monotone, regimes, robust, score, trees


def test_group_ols_and_nonnegative_weights(spark):
    rng = random.Random(2)
    rows = [(i, i % 3, rng.uniform(0, 1e5), rng.uniform(-50, 50)) for i in range(200)]
    rows = [(i, g, a, b, 7 + (g + 1) * a - 3 * b + rng.gauss(0, 5)) for i, g, a, b in rows]
    df = spark.createDataFrame(rows, "id long, g long, a double, b double, y double")
    got = {r.id: r.p for r in calib.group_ols(df, df, ["g"], ["a", "b"], "y", 67, "p").collect()}
    for g in range(3):
        part = [r for r in rows if r[1] == g] if sum(r[1] == g for r in rows) >= 67 else rows
        x = np.array([[1, r[2], r[3]] for r in part])
        w = np.linalg.lstsq(x, np.array([r[4] for r in part]), rcond=None)[0]
        for r in (r for r in rows if r[1] == g):
            assert abs(got[r[0]] - w @ [1, r[2], r[3]]) < 1e-4
    mixed = df.select("a", (-F.col("a")).alias("c"), F.lit(3.0).alias("d"), (F.col("a") * 0.5 + 1.5).alias("y"))
    w = calib.nonnegative_weights(mixed, ["a", "c", "d"], "y")
    assert w["c"] == 0.0 and abs(w["a"] - 0.5) < 1e-6 and abs(w["d"] - 0.5) < 1e-6
    assert calib.nonnegative_weights(mixed.where("a < 0"), ["a", "c"], "y") == {"a": 0.0, "c": 0.0}


def test_nonnegative_active_set_is_the_best_support():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        for _ in range(20):
            x, y = rng.normal(size=(40, n)), rng.normal(size=40)
            w = calib._nonnegative(x.T @ x, x.T @ y)
            left = x.T @ (y - x @ w)
            assert (w >= 0).all() and (left < 1e-6).all() and (np.abs(left[w > 0]) < 1e-6).all()


def pool(y, w):
    blocks = []
    for v, n in zip(y, w):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [v for v, _, k in blocks for _ in range(k)]


def test_isotonic_equals_pooling(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randrange(30)), rng.uniform(0, 100)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    got = {r.x: r.p for r in monotone.isotonic(df, df, "x", "y", "p").collect()}
    xs = sorted({x for _, x, _ in rows})
    groups = [[y for _, x, y in rows if x == v] for v in xs]
    want = pool([sum(g) / len(g) for g in groups], [len(g) for g in groups])
    assert all(abs(got[x] - p) < 1e-9 for x, p in zip(xs, want))


def test_boosting_improves_and_specialist_stays_on_its_slice(spark):
    rng = random.Random(4)
    rows = [(i, float(i % 7), rng.uniform(0, 1), i % 2 == 0) for i in range(400)]
    rows = [(i, a, b, m, 100 * a + 50 * b + (500 if m else 0), 300.0) for i, a, b, m in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, m boolean, y double, base double")
    got = boost.residual_boost(df, df, ["a", "b"], "y", "base", "p", settings=trees.Settings(rounds=5, depth=3, rate=0.3))
    s = {r.predictor: r.rmse for r in score.league(got, "y", {"base": F.col("base"), "p": F.col("p")}).collect()}
    assert s["p"] < s["base"]
    special = boost.slice_specialist(df, df, F.col("m"), ["a", "b"], "y", "base", "p", settings=trees.Settings(rounds=3, depth=3, rate=0.3))
    assert special.where("NOT m AND p <> base").count() == 0
    assert special.where("m AND p = base").count() == 0


def test_same_seed_same_sample_and_vocabulary(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 9 else "z") for i in range(10)], "id long, c string")
    a = [r.id for r in history.sample_rows(df, "id", 4, 7).collect()]
    assert a == [r.id for r in history.sample_rows(df.repartition(3), "id", 4, 7).collect()] and len(a) == 4
    want = sorted((hashlib.md5(f"{r.id}:7".encode()).hexdigest(), r.id) for r in df.select("id").collect())[:4]
    assert a == [i for _, i in want]
    vocab = {r.category: r.code for r in history.vocabulary(df, "c", 2).collect()}
    assert vocab == {"a": 2, "b": 3, "c": 4}
    assert {r.code for r in history.encode(df, "c", history.vocabulary(df, "c", 2), "code").where("c = 'z'").collect()} == {1}


def test_history_padding_and_audit(spark):
    df = spark.createDataFrame([(i, 0, (i // 2) * 1_000_000) for i in range(9)], "id long, k long, t long")
    got = history.histories(df, ["k"], ["t", "id"], 4, {"id": "id"}, "t")
    assert all(len(r.history) == 4 for r in got.collect())
    row = {r.id: [e.id for e in r.history if e.valid] for r in got.collect()}
    assert row[5] == [1, 2, 3] and row[4] == [0, 1, 2, 3] and row[0] == []
    audit = history.leakage_audit(got, "t", "id", "id").first()
    assert (audit.rows, audit.future, audit.self, audit.empty) == (9, 0, 0, 2)


def test_packed_histories_are_linear(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice(["a", None, "b"]), rng.randrange(90)) for i in range(400)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, t long").repartition(3)
    index, store, shared = history.pack(df, ["k"], ["t", "id"], 7, {"id": "id"}, "t", 20)
    assert store.agg(F.sum(F.size("_events"))).first()[0] <= 400 * (1 + 7 / 20) and index.count() == 401
    got = {r.id: r.history for r in history.histories(df, ["k"], ["t", "id"], 7, {"id": "id"}, "t", chunk=20).collect()}
    for k in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == k and r[2] is not None), key=lambda r: (r[2], r[0]))
        for i, r in enumerate(mine):
            want = [x[0] for x in mine[max(0, i - 7) : i] if x[2] < r[2]]
            assert [e.id for e in got[r[0]] if e.valid] == want and len(got[r[0]]) == 7
            assert all(abs(e.gap - (r[2] - e.event_at) / 1e6) < 1e-12 for e in got[r[0]] if e.valid)
    assert got[900] is None


def test_verdict_and_threshold_rule(spark):
    s = spark.createDataFrame([("base", 100.0, 50.0), ("a", 98.0, 52.0), ("b", 99.9, 40.0)], "candidate string, first double, second double")
    assert score.verdict(s, "base", (1.5, 3.0), (0.5, 5.0)).first().asDict() == {"best": "a", "gain_first": 2.0, "gain_second": -2.0, "verdict": "ACCEPT"}
    df = spark.createDataFrame([(float(i), 10.0 if i > 50 else 0.0, 10.0, 0.0) for i in range(101)], "x double, y double, r double, o double")
    got = calib.threshold_rule(df, "x", "y", "r", "o", [0.25, 0.5, 0.75]).first()
    assert (got.threshold, got.side, got.rmse) == (50.0, "gt", 0.0)


def test_robust_corrections(spark):
    df = spark.createDataFrame([(i, i % 2, float(i if i < 99 else 10_000)) for i in range(100)], "id long, g int, r double")
    x = np.array([float(i if i < 99 else 10_000) for i in range(100)])
    lo, hi = np.quantile(x, [0.05, 0.95])
    assert abs(robust.winsorised_mean(df, [], "r").first().winsor - np.clip(x, lo, hi).mean()) < 1e-9
    scale = robust.robust_scale(df, "r").first()
    assert scale.mad == np.median(np.abs(x - np.median(x))) and scale.n == 100
    assert robust.positive_median(df.where("r < 0"), "r").first().scale == 1800.0


def test_monotone_fits_of_groups_merge(spark, monkeypatch):
    """Pools of slices, pooled again, are the pools of all points; null groups, rows without a score and unknown groups."""
    rng = random.Random(13)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(-40, 40)), None, float("nan"), rng.uniform(-1e6, 1e6)]), float(rng.randrange(100))) for i in range(500)]
    rows = [(i, g, x, y + (x or 0) / 1e5 if x == x else None) for i, g, x, y in rows]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(4)
    asked = df.select("id", "g", "x").union(spark.createDataFrame([(900, "a", 0.5), (901, "a", -1e9), (902, "a", 1e9), (903, "new", 1.0), (904, None, None)], "id long, g string, x double"))
    got = {r.id: r.p for r in monotone.isotonic(df, asked, "x", "y", "p", ["g"]).collect()}
    assert len(got) == 505
    for g in ("a", "b", None):
        part = {}
        for _, h, x, y in rows:
            if h == g and x is not None and x == x and y is not None:
                part.setdefault(x, []).append(y)
        xs = sorted(part)
        fit = pool([sum(part[x]) / len(part[x]) for x in xs], [len(part[x]) for x in xs])
        for r in asked.where(F.col("g").eqNullSafe(F.lit(g))).collect():
            usable = r.x is not None and r.x == r.x
            assert got[r.id] is None if not usable else abs(got[r.id] - np.interp(r.x, xs, fit)) < 1e-9
    assert got[903] is None


def test_regimes_are_found_and_silhouettes_exact(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9], [4.5, 20]])
    own = rng.integers(0, 5, 300)
    x = centres[own] + rng.normal(0, 0.5, (300, 2))
    rows = [(i, float(a), float(b), f"c{c}", None if i % 9 else "z", "one") for i, ((a, b), c) in enumerate(zip(x, own))] + [(300, None, float("nan"), "alone", None, "one")]
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, few string, one string").repartition(3)
    model = regimes.fit(df.where("id < 300"), ["a", "b"], [3, 4, 5, 6], starts=4)
    got = {r.id: r.regime for r in regimes.assign(model, df, "regime").collect()}
    assert len(model.centres) == 5 and len({(got[i], own[i]) for i in range(300)}) == 5 and got[300] is not None
    assert model.inertia[6] < model.inertia[5] < model.inertia[4] < model.inertia[3]
    z = np.concatenate((x, [[0, 0]]))
    apart = ((z[:, None] - z[None]) ** 2).sum(2)
    label = np.append(own, 9)
    want = []
    for i in range(301):
        mean = {c: apart[i][label == c].sum() / ((label == c).sum() - (c == label[i])) for c in set(label) if (label == c).sum() > (c == label[i])}
        a, b = mean.get(label[i]), min(v for c, v in mean.items() if c != label[i])
        want.append(0 if a is None else (b - a) / max(a, b))
    got = {r["set"]: r.silhouette for r in regimes.silhouettes(df, ["c", "one", "few"], ["a", "b"]).collect()}
    assert abs(got["c"] - np.mean(want)) < 1e-9 and got["one"] is None and got["few"] is None
    empty = regimes.fit(df.where("false"), ["a", "b"], [3, 4], starts=2, rounds=2)
    assert empty.silhouettes == {3: -1.0, 4: -1.0}
