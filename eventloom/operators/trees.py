"""Second-order boosted trees, many models at a time, grown from histograms that Spark adds up.

Inputs are cut at quantiles into at most ``bins`` codes of a byte; a missing input is a code of its own below all others. Rows
lie packed in blocks, sorted by model, with their scores. Once a round the trees of the last one are added to the scores, and the rows drawn get
their gradient and curvature; both stay persisted on disk while the round lasts. For each level of its trees, tasks put those rows into their
nodes and add them to histograms by (model, node, input, code); a task for each model sums them over the blocks and finds the best split of
each node, and only the splits reach the driver. All models grow in the same jobs, so the number of jobs is that of levels times rounds
whatever the number of models. Rows may belong to several models (an entity's and the pooled one, or one for each seed).

A round's steps: rows and inputs are sampled by hashes, trees of ``depth`` levels are grown, leaves get ``-G / (H + shrink) * rate``,
or for the quantile loss the quantile of what is left in them. Rows held out measure the loss; a model stops when it has not got better for
``patience`` rounds, and keeps the best ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.profile import forbid_columns
from eventloom.operators.ranks import quantiles
from eventloom.sources.scratch import written

#: Bins of what is left over, for leaves of the quantile loss.
REST_BINS = 2048
#: Rounds after which rows' scores are written again, so a lost block repeats no more trees than these.
KEEP_ROUNDS = 25
#: Rows of a block, and so those that a task has in its hands at a time.
BLOCK_ROWS = 1 << 15
#: How blocks are written. A row is a block of a MB or two, so sizes are looked at with each row (the writer's default is from the hundredth on):
#: a reader has a whole row group in its memory.
BLOCK_FILES = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
#: Where a round's rows stay: on disk, which the system keeps in memory as far as there is some. In an executor's heap they lie in chunks of a MB and
#: a few bytes, each of which takes two regions of a small heap, so the share that Spark allows for them would fill all of it.
KEPT = StorageLevel.DISK_ONLY


@dataclass(frozen=True)
class Settings:
    """How trees are grown. ``loss`` is squared, huber, quantile or logistic; ``at`` its threshold or quantile."""

    rounds: int = 100
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    shrink: float = 1.0
    least_rows: int = 20
    rows: float = 0.8
    inputs: float = 0.8
    patience: int = 5
    loss: str = "squared"
    at: float = 0.5


@dataclass
class Forest:
    """Trees of several models: for model m and round r, node i of a tree splits input ``where[r][m, i]`` at code ``cut[r][m, i]``."""

    models: list
    inputs: list[str]
    edges: list[np.ndarray]
    settings: Settings
    start: np.ndarray
    where: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    best: np.ndarray | None = None
    gains: np.ndarray | None = None
    losses: list[np.ndarray] = field(default_factory=list)

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Codes of the inputs, a row each: 0 is missing."""
        out = np.zeros((len(columns[0]), len(columns)), np.uint8)
        for i, x in enumerate(columns):
            known = ~np.isnan(x)
            out[known, i] = 1 + np.searchsorted(self.edges[i], x[known], "left")
        return out

    def score(self, codes: np.ndarray, model: np.ndarray) -> np.ndarray:
        """What the trees add to the base, before any link."""
        total = self.start[model].copy()
        for r in range(len(self.leaf)):
            value = _walk(codes, model, self.where[r], self.cut[r], self.leaf[r])
            total += np.where(r < self.best[model], value, 0) if self.best is not None else value
        return total


def _node(codes: np.ndarray, model: np.ndarray | int, where: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of the given level that each row is in; a node without a split sends all rows to its lower side."""
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for level in range(levels):
        i = at + (1 << level) - 1
        f = where[model, i]
        at = 2 * at + ((f >= 0) & (codes[rows, np.maximum(f, 0)] > cut[model, i]))
    return at


def _walk(codes: np.ndarray, model: np.ndarray | int, where: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    return leaf[model, _node(codes, model, where, cut, int(leaf.shape[1]).bit_length() - 1)]


def _steps(s: Settings, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient, curvature and loss of each row."""
    off = score - y
    if s.loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6), np.logaddexp(0, score) - y * score
    if s.loss == "huber":
        near = np.abs(off) <= s.at
        return np.clip(off, -s.at, s.at), np.ones(len(y)), np.where(near, off * off / 2, s.at * (np.abs(off) - s.at / 2))
    if s.loss == "quantile":
        return np.where(off > 0, 1 - s.at, -s.at), np.ones(len(y)), np.where(off > 0, (1 - s.at) * off, -s.at * off)
    return off, np.ones(len(y)), off * off / 2


def _hash(x: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers from 0 up to 1 that look random, from 64-bit keys and a salt."""
    seed = int.from_bytes(hashlib.sha256(repr(salt).encode()).digest()[:8], "little")
    h = x.astype(np.uint64) ^ np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return (h ^ (h >> np.uint64(33))).astype(np.float64) / 2.0**64


def _bytes(**columns: np.ndarray) -> dict[str, list[bytes]]:
    return {n: [np.ascontiguousarray(x).tobytes()] for n, x in columns.items()}


_KINDS = {"model": np.int32, "key": np.int64, "y": np.float64, "weight": np.float64, "score": np.float64, "held": np.bool_}
_BLOCKS = "codes binary, " + ", ".join(f"{n} binary" for n in _KINDS)


def _block(row) -> dict[str, np.ndarray]:
    out = {n: np.frombuffer(row[n], k) for n, k in _KINDS.items()}
    return out | {"codes": np.frombuffer(row["codes"], np.uint8).reshape(len(out["y"]), -1)}


def _edges(train: DataFrame, inputs: list[str], bins: int) -> list[np.ndarray]:
    """Where inputs are cut: their quantiles, and every value of one that has few."""
    shares = [F.lit(i / bins) for i in range(1, bins)]
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in inputs}
    got = train.agg(*[F.percentile_approx(x[c], F.array(*shares), 10_000).alias(c) for c in inputs]).first()
    return [np.unique(np.array(got[c] or [], np.float64)) for c in inputs]


def fit(
    train: DataFrame, inputs: list[str], y: Column, models: list, member: Column, seeds: list[int] | None = None,
    settings: Settings = Settings(), base: Column | None = None, weight: Column | None = None, held: Column | None = None, tie: Column | None = None, refuse: tuple[str, ...] = (),
) -> Forest:
    """Grow one model for each of ``models`` in the same jobs.

    ``member`` is an array of the numbers (from 0) of the models a row belongs to. ``y`` is learnt beyond ``base`` (0 without one). Rows
    without y or base are left out. ``held`` marks rows that only measure the loss, for early stopping; without any all rounds are
    grown. ``tie`` is a number that rows are sampled by, the hash of their inputs and y if none is given. ``seeds`` names each
    model's seed. ``refuse`` names parts of input names that a fit must not use. A model without rows predicts its base.
    """
    forbid_columns(train.select(*inputs), list(refuse))
    s, spark = settings, train.sparkSession
    seeds = seeds or [1] * len(models)
    lit = F.lit(0.0) if base is None else base.cast("double")
    rows = train.withColumns({"_y": y.cast("double"), "_base": lit, "_w": (F.lit(1.0) if weight is None else weight.cast("double"))})
    rows = rows.withColumn("_held", F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)).withColumn("_member", member)
    rows = rows.withColumn("_key", F.xxhash64(*inputs, "_y") if tie is None else tie.cast("long"))
    rows = rows.where(F.col("_y").isNotNull() & F.col("_base").isNotNull() & (F.col("_w") > 0)).select(*inputs, "_y", "_base", "_w", "_held", "_key", F.explode("_member").alias("_model"))
    forest = Forest(models, inputs, _edges(train, inputs, s.bins), s, np.zeros(len(models)))
    learnt = rows.where("not _held").groupBy("_model")
    if s.loss in ("quantile", "huber"):
        first = quantiles(rows.where("not _held"), ["_model"], F.col("_y") - F.col("_base"), {"v": s.at if s.loss == "quantile" else 0.5})
    elif s.loss == "logistic":
        p = F.greatest(F.least(F.sum(F.col("_y") * F.col("_w")) / F.sum("_w"), F.lit(1 - 1e-6)), F.lit(1e-6))
        first = learnt.agg(F.log(p / (1 - p)).alias("v"))
    else:
        first = learnt.agg((F.sum((F.col("_y") - F.col("_base")) * F.col("_w")) / F.sum("_w")).alias("v"))
    for r in first.collect():  # a number for each model
        forest.start[r["_model"]] = r["v"]

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _gathered(batches):
            pdf = pdf.sort_values("_model", kind="stable")
            model = pdf["_model"].to_numpy(np.int32)
            columns = [pdf[c].to_numpy(np.float64, na_value=np.nan) for c in inputs]
            score = pdf["_base"].to_numpy(np.float64) + forest.start[model]
            yield pd.DataFrame(_bytes(codes=forest.codes(columns), model=model, key=pdf["_key"].to_numpy(np.int64), y=pdf["_y"].to_numpy(np.float64), weight=pdf["_w"].to_numpy(np.float64), score=score, held=pdf["_held"].to_numpy(bool)))

    ready = [F.col(c).cast("double").alias(c) for c in inputs]
    blocks = written(rows.select(*ready, "_y", "_base", "_w", "_held", "_key", F.col("_model").cast("int").alias("_model")).mapInPandas(packed, _BLOCKS), "blocks", options=BLOCK_FILES)
    many, width, codes = len(models), len(inputs), s.bins + 1
    open_, done, best = np.ones(many, bool), np.zeros(many, np.int64), np.full(many, np.inf)
    forest.gains = np.zeros((many, width))
    measured = held is not None
    state, drawn, old = blocks.rdd.map(_block), None, None

    try:
        for r in range(s.rounds):
            if r and r % KEEP_ROUNDS == 0:
                state, last = _rescored(spark, state), state
                last.unpersist()
            state = state.persist(KEPT)
            drawn = state.map(_drawn(s, r, seeds)).persist(KEPT)
            where, cut = np.full((many, (1 << s.depth) - 1), -1, np.int32), np.zeros((many, (1 << s.depth) - 1), np.int32)
            leaf = np.zeros((many, 1 << s.depth))
            for level in range(s.depth):
                for m, node, input_, code, gain, left, right, loss in _splits(drawn, s, r, where, cut, open_, level, seeds, (width, codes)).collect():  # a row for each node of each model
                    if node < 0:  # the rows held out, as the trees so far leave them
                        if loss < best[m] - 1e-12:
                            best[m], done[m] = loss, r
                        elif r - done[m] >= s.patience:
                            open_[m] = False
                        continue
                    i = node + (1 << level) - 1
                    where[m, i], cut[m, i] = input_, code
                    if input_ >= 0:
                        forest.gains[m, input_] += gain
                    if level + 1 == s.depth:
                        leaf[m, [node << 1, (node << 1) + 1]] = left * s.rate, right * s.rate
                if old is not None:
                    old, _ = None, old.unpersist()
                if not open_.any():
                    break
            if not open_.any() or (where[open_] < 0).all() and s.loss != "quantile" and s.inputs == s.rows == 1:
                break
            if s.loss == "quantile":
                leaf = _rest_quantiles(state, s, where, cut, open_, leaf.shape)
            leaf[~open_] = 0
            forest.where.append(where)
            forest.cut.append(cut)
            forest.leaf.append(leaf)
            drawn.unpersist()
            state, old = state.map(_grown(where, cut, leaf, open_.copy())), state
    finally:
        for held_rows in (state, drawn, old):
            if held_rows is not None:
                held_rows.unpersist()
    forest.best = np.where(np.isfinite(best), done, len(forest.leaf)) if measured else np.full(many, len(forest.leaf))
    return forest


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arrow batches put together to blocks of BLOCK_ROWS rows or a little more."""
    parts: list[pd.DataFrame] = []
    for pdf in batches:
        parts.append(pdf)
        if sum(map(len, parts)) >= BLOCK_ROWS:
            yield pd.concat(parts, ignore_index=True)
            parts = []
    if any(map(len, parts)):
        yield pd.concat(parts, ignore_index=True)


def _stretches(model: np.ndarray) -> list[tuple[int, slice]]:
    """The rows of every model in a block, whose rows lie in the order of their models."""
    found, first = np.unique(model, return_index=True)
    return [(int(m), slice(a, b)) for m, a, b in zip(found, first, [*first[1:], len(model)])]


def _grown(where: np.ndarray, cut: np.ndarray, leaf: np.ndarray, open_: np.ndarray) -> Callable[[dict], dict]:
    """Put a round's trees into a block's scores, and leave out the rows of models that have stopped."""

    def work(b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        some = open_[b["model"]]
        b = b if some.all() else {n: x[some] for n, x in b.items()}
        score = b["score"].copy()
        for m, rows in _stretches(b["model"]):
            score[rows] += _walk(b["codes"][rows], m, where, cut, leaf)
        return b | {"score": score}

    return work


def _rescored(spark: SparkSession, state: RDD) -> RDD:
    """The same blocks from a written table, so that their lineage is short again; those whose models have all stopped are empty, and left out."""
    rows = state.filter(lambda b: len(b["y"]) > 0).map(lambda b: tuple(np.ascontiguousarray(b[n]).tobytes() for n in ("codes", *_KINDS)))
    return written(spark.createDataFrame(rows, _BLOCKS, verifySchema=False), "blocks", options=BLOCK_FILES).rdd.map(_block)


def _drawn(s: Settings, r: int, seeds: list[int]) -> Callable[[dict], dict]:
    """What a round's levels need of a block: the rows drawn with gradient and curvature (None: all 1), and each model's loss of the rows held out."""

    def work(b: dict[str, np.ndarray]) -> dict:
        grad, curve, loss = _steps(s, b["y"], b["score"])
        out, held = np.zeros(len(grad), bool), {}
        for m, rows in _stretches(b["model"]):
            mine, w = b["held"][rows], b["weight"][rows]
            held[m] = np.array([(loss[rows] * w)[mine].sum(), w[mine].sum()])
            out[rows] = ~mine & (_hash(b["key"][rows], seeds[m], r) < s.rows)
        w = b["weight"][out]
        h = curve[out] * w
        return {"model": b["model"][out], "codes": b["codes"][out], "grad": grad[out] * w, "curve": None if (h == 1).all() else h, "held": held}

    return work


def _splits(drawn: RDD, s: Settings, r: int, where: np.ndarray, cut: np.ndarray, open_: np.ndarray, level: int, seeds: list[int], shape: tuple[int, int]) -> RDD:
    """The best split of every node of a level in every model, and on the first level the loss of the rows held out (node -1).

    Rows are (model, node, input, code, gain, value below, value above, loss).
    """
    nodes, (width, codes) = 1 << level, shape
    where, cut, open_ = where.copy(), cut.copy(), open_.copy()

    def add(blocks: Iterator[dict]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
        sums: dict[int, np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        for b in blocks:
            for m, x in b["held"].items():
                if open_[m]:
                    held[m] = held.get(m, 0) + x
                    sums.setdefault(m, np.zeros((3, nodes, width, codes)))
            for m, rows in _stretches(b["model"]):
                if not open_[m]:
                    continue
                own, grad, curve, total = b["codes"][rows], b["grad"][rows], b["curve"], sums[m]
                first = _node(own, m, where, cut, level) * codes
                for f in range(width):
                    at = first + own[:, f]
                    n = np.bincount(at, minlength=nodes * codes).reshape(nodes, codes)
                    total[0, :, f] += np.bincount(at, grad, nodes * codes).reshape(nodes, codes)
                    total[1, :, f] += n if curve is None else np.bincount(at, curve[rows], nodes * codes).reshape(nodes, codes)
                    total[2, :, f] += n
        for m, x in sums.items():
            yield m, (x, held[m] if not level else np.zeros(2))

    def choose(found: tuple[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        m, ((g, h, n), (loss, weight)) = found
        used = _hash(np.arange(width), seeds[m], r, 77)
        used = used <= np.sort(used)[max(0, int(np.ceil(s.inputs * width)) - 1)]
        gl, hl, nl = (np.cumsum(x, 2)[:, :, :-1] for x in (g, h, n))
        gt, ht, nt = (x[:, 0].sum(1)[:, None, None] for x in (g, h, n))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / (hl + s.shrink) + (gt - gl) ** 2 / (ht - hl + s.shrink) - gt**2 / (ht + s.shrink)
        gain = np.where((nl >= s.least_rows) & (nt - nl >= s.least_rows) & used[:, None], gain, -np.inf).reshape(nodes, -1)
        top = gain.argmax(1)
        out = []
        for i in range(nodes):
            f, c = divmod(int(top[i]), codes - 1)
            below, above = float(gt[i, 0, 0]), float(ht[i, 0, 0])
            if gain[i, top[i]] > 1e-9:
                a, b = float(gl[i, f, c]), float(hl[i, f, c])
                out.append((m, i, f, c, float(gain[i, top[i]]), -a / (b + s.shrink), -(below - a) / (above - b + s.shrink), 0.0))
            else:
                out.append((m, i, -1, 0, 0.0, -below / (above + s.shrink) if above + s.shrink else 0.0, 0.0, 0.0))
        if weight > 0:
            out.append((m, -1, -1, 0, 0.0, 0.0, 0.0, float(loss / weight)))
        return out

    tasks = min(len(seeds), drawn.context.defaultParallelism)
    return drawn.mapPartitions(add).reduceByKey(lambda x, y: (x[0] + y[0], x[1] + y[1]), tasks).flatMap(choose)


def _rest_quantiles(state: RDD, s: Settings, where: np.ndarray, cut: np.ndarray, open_: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Leaves of the quantile loss: the quantile of what is left over in each, from counts in fine bins between the extremes."""
    many, leaves = shape
    tasks, open_ = min(many, state.context.defaultParallelism), open_.copy()

    def rest(blocks: Iterator[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for b in blocks:
            for m, rows in _stretches(b["model"]):
                some = ~b["held"][rows]
                if open_[m] and some.any():
                    node = _node(b["codes"][rows][some], m, where, cut, leaves.bit_length() - 1)
                    yield m, node, (b["y"][rows] - b["score"][rows])[some], b["weight"][rows][some]

    def extremes(blocks: Iterator[dict]) -> Iterator[tuple[int, np.ndarray]]:
        out: dict[int, np.ndarray] = {}
        for m, node, left, _ in rest(blocks):
            ends = out.setdefault(m, np.full((2, leaves), np.inf))
            np.minimum.at(ends[0], node, left)
            np.minimum.at(ends[1], node, -left)
        yield from out.items()

    low, high = np.zeros(shape), np.ones(shape)
    for m, ends in state.mapPartitions(extremes).reduceByKey(np.minimum, tasks).collect():  # the leaves of each model
        met = np.isfinite(ends[0])
        low[m, met], high[m, met] = ends[0][met], -ends[1][met]

    def counts(blocks: Iterator[dict]) -> Iterator[tuple[int, np.ndarray]]:
        out: dict[int, np.ndarray] = {}
        for m, node, left, weight in rest(blocks):
            lo, hi = low[m, node], high[m, node]
            bin_ = np.minimum((left - lo) / np.maximum(hi - lo, 1e-300) * REST_BINS, REST_BINS - 1).astype(np.int64)
            out[m] = out.get(m, 0) + np.bincount(node * REST_BINS + bin_, weight, leaves * REST_BINS)
        yield from out.items()

    def choose(found: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
        m, value = found[0], np.zeros(leaves)
        for i, weight in enumerate(found[1].reshape(leaves, REST_BINS)):
            bins = np.flatnonzero(weight)
            if len(bins):
                share = np.cumsum(weight[bins]) / weight[bins].sum()
                at = int(bins[min(int(np.searchsorted(share, s.at)), len(bins) - 1)])
                value[i] = low[m, i] + (at + 0.5) / REST_BINS * (high[m, i] - low[m, i])
        return m, value

    leaf = np.zeros(shape)
    for m, value in state.mapPartitions(counts).reduceByKey(lambda x, y: x + y, tasks).map(choose).collect():
        leaf[m] = value * s.rate
    return leaf


def predict(forest: Forest, df: DataFrame, name: str, model: Column | None = None) -> DataFrame:
    """Append what the trees add to the base for the model whose number ``model`` gives (the first if none); null where that is null."""
    send = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def added(model: pd.Series, columns: pd.DataFrame) -> pd.Series:
        known = model.notna().to_numpy()
        out = np.full(len(model), np.nan)
        f = send.value
        values = [columns[c].to_numpy(np.float64, na_value=np.nan)[known] for c in f.inputs]
        out[known] = f.score(f.codes(values), model[known].to_numpy(np.int64))
        return pd.Series(out).where(known, None)

    number = (F.lit(0) if model is None else model).cast("int")
    return df.withColumn(name, added(number, F.struct(*[F.col(c).cast("double").alias(c) for c in forest.inputs])))


def importance(forest: Forest, model: int = 0) -> dict[str, float]:
    """Share of the gain of all splits that each input has."""
    gains = forest.gains[model]
    return dict(zip(forest.inputs, (gains / gains.sum() if gains.sum() else gains).tolist()))
