"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters in lower case, and their first bytes), hashed to 2**BITS features. The score of a set is the logistic of
bias + sum of weights + sum over pairs of the dot product of their factor vectors, so a pair (an insult and a group that is
mentioned) has a weight of its own beyond what its terms have alone. The pair sum is computed in linear time from the sum of
the vectors and of their squares. Learning is by stochastic gradients on a bounded sample of labelled rows (plain ones: steps that adapt to rare terms learn them by heart); scoring is a pass over all texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import NO_ID, id_or_none, texts, written
from eventloom.llm.words import mix, word_hashes

BITS, FACTORS = 18, 8
#: Bytes of a term's beginning that are a term of their own.
STEMS = (4, 6)
#: Labelled rows that the classifier is learnt from at most: those with the smallest hashed ids. About 30 MB of features.
SAMPLE = 20_000
#: A term has a weight when it is seen in this many texts of the sample, or in this share of them.
SUPPORT, SHARE = 3, 1 / 1500
_NO_LETTERS = re.compile(r"[\W\d_]+")


def features(text: str | None) -> np.ndarray:
    """The different hashed terms of a text: whole runs of letters, and their beginnings, which inflected forms share."""
    letters = _NO_LETTERS.sub(" ", (text or "").lower())
    h = [word_hashes(letters)[0]] + [mix(word_hashes(letters, most=k)[0] ^ np.uint64(k)) for k in STEMS]
    return np.unique(np.concatenate(h) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores before the logistic, of sets that lie one after the other in ``flat``."""
        out = np.full(len(sizes), self.bias, np.float64)
        full = np.flatnonzero(sizes)
        if len(full):
            at = (np.cumsum(sizes) - sizes)[full]
            v = self.vectors.take(flat, 0)
            total = np.add.reduceat(v, at)
            pairs = ((total**2).sum(1) - np.add.reduceat(np.einsum("ij,ij->i", v, v), at)) / 2
            out[full] += np.add.reduceat(self.weights.take(flat), at) + pairs
        return out

    def score(self, sets: list[np.ndarray]) -> np.ndarray:
        if not sets:
            return np.zeros(0)
        x = self.raw(np.concatenate(sets), np.array([len(s) for s in sets]))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learn(sets: list[np.ndarray], labels: np.ndarray, **how) -> Machine:
    """Fit on sets of features with labels 0 and 1; without both labels the machine says the share of ones throughout."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int32)
    seen = np.bincount(flat, minlength=1 << BITS) >= least_seen(len(sets))
    keep = seen[flat]
    return fit(flat[keep], np.add.reduceat(np.append(keep, False).astype(np.int64), np.cumsum(sizes) - sizes) * (sizes > 0) if len(sets) else sizes, labels, **how)


def least_seen(sets: int) -> float:
    """Sets that a feature must be in to have a weight."""
    return max(SUPPORT, SHARE * sets)


def fit(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int | None = None, rate: float = 0.01, shrink: float = 2e-2, batch: int = 64, seed: int = 7) -> Machine:
    """As ``learn``, from sets of features that have a weight, which lie one after the other in ``flat``."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32))
    if len(np.unique(labels)) < 2:
        return m
    rounds = rounds or int(np.clip(120_000 / len(sizes), 8, 60))
    begin = np.cumsum(sizes) - sizes
    in_use = np.zeros(size, bool)
    in_use[flat] = True
    used = np.flatnonzero(in_use)
    m.vectors[used] = rng.normal(0, 0.01, (len(used), FACTORS))
    met, number = np.zeros(size, bool), np.zeros(size, np.int64)
    for _ in range(rounds):
        order = rng.permutation(len(sizes))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            own = np.repeat(np.arange(len(some)), sizes[some])
            if not len(own):
                continue
            at = np.cumsum(sizes[some]) - sizes[some]
            terms = flat.take(np.arange(len(own)) + (begin[some] - at).take(own))
            v, w = m.vectors.take(terms, 0), m.weights.take(terms)
            x, total = np.full(len(some), m.bias, np.float64), np.zeros((len(some), FACTORS), np.float32)
            full = np.flatnonzero(sizes[some])
            at = at[full]
            total[full] = np.add.reduceat(v, at)
            x[full] += np.add.reduceat(w, at) + ((total[full] ** 2).sum(1) - np.add.reduceat(np.einsum("ij,ij->i", v, v), at)) / 2
            error = 1 / (1 + np.exp(-np.clip(x, -30, 30))) - labels[some]
            m.bias -= rate * float(error.sum()) / 10
            met[terms] = True  # the batch's features in order, without a sort
            f = np.flatnonzero(met)
            met[f] = False
            number[f] = np.arange(len(f))
            at = number[terms]
            e = np.bincount(at, error.take(own), len(f)).astype(np.float32)
            g = e + shrink * m.weights[f]
            # d/dv = sum of errors times (the set's total less the feature's own vector)
            push = error[:, None] * total
            gv = np.stack([np.bincount(at, push[:, d].take(own), len(f)) for d in range(FACTORS)], 1).astype(np.float32)
            gv += (shrink - e[:, None]) * m.vectors[f]
            m.weights[f] -= rate * g
            m.vectors[f] -= 0.1 * rate * np.clip(gv, -1, 1)
    return m


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"_toxic": pdf["_toxic"], "_set": [features(t).tobytes() for t in pdf["_text"]]})


def _support(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """In how many sets of a task each feature is."""
    total = np.zeros(1 << BITS, np.int64)
    for pdf in batches:
        total += np.bincount(np.frombuffer(b"".join(pdf["_set"]), np.int32), minlength=len(total))
    met = np.flatnonzero(total)
    yield pd.DataFrame({"_feature": met.astype(np.int32), "_n": total[met]})


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from labelled rows outside the held-out fold; null labels and ids are left out.

    Of labels that repeat an id, and of rows whose texts have the same features, the larger label counts, once. Features are counted
    on Spark, and one task learns from the bounded sample; only the features that have a weight, and then their weights, reach the driver.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("_id"), labels["toxic"].cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.where(fold(F.col("_id")) != 0).groupBy("_id").agg(F.max("_toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # at most ``sample`` rows of 12 bytes
    found = texts(docs).join(F.broadcast(known), "_id").mapInPandas(_features, "_toxic int, _set binary")
    different = found.groupBy("_set").agg(F.max("_toxic").alias("_toxic"))
    # ids that repeat do not lift the bound
    rows = written(different.orderBy(F.xxhash64("_set"), "_set").limit(2 * sample), "sample")
    counted = rows.mapInPandas(_support, "_feature int, _n bigint").groupBy("_feature").agg(F.sum("_n").alias("_n"))
    kept, total = np.zeros(1 << BITS, bool), 0
    for r in counted.where(F.col("_n") >= least_seen(rows.count())).toLocalIterator():
        kept[r["_feature"]], total = True, total + r["_n"]

    def learnt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one array of the known length, filled as the rows come
        flat, at, sizes, marks = np.empty(total, np.int32), 0, [], []
        for pdf in batches:
            for x in pdf["_set"]:
                part = np.frombuffer(x, np.int32)
                part = part[kept[part]]
                flat[at : at + len(part)], at = part, at + len(part)
                sizes.append(len(part))
            marks.append(pdf["_toxic"].to_numpy(np.float64))
        m = fit(flat, np.array(sizes, np.int64), np.concatenate([*marks, np.zeros(0)]))
        used = np.flatnonzero((m.weights != 0) | (m.vectors != 0).any(axis=1))
        yield pd.DataFrame({"_bias": [m.bias]} | {n: [x.tobytes()] for n, x in (("_used", used), ("_weights", m.weights[used]), ("_vectors", m.vectors[used]))})

    m = learn([], np.zeros(0))
    for r in rows.coalesce(1).mapInPandas(learnt, "_bias double, _used binary, _weights binary, _vectors binary").collect():
        used, m.bias = np.frombuffer(r["_used"], np.int64), r["_bias"]
        m.weights[used], m.vectors[used] = np.frombuffer(r["_weights"], np.float32), np.frombuffer(r["_vectors"], np.float32).reshape(-1, FACTORS)
    return m


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text); null and blank texts have no terms, and so
    the bias as their score; null and repeated ids give a row each; other columns are ignored."""
    send = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"_id": pdf["_id"], "score": send.value.score([features(t) for t in pdf["_text"]])})

    out = texts(docs).mapInPandas(score, "_id bigint, score double")
    held_out = F.when(F.col("_id") == NO_ID, True).otherwise(fold(F.col("_id")) == 0)
    return out.select(id_or_none("_id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that are not held out, and score every row; see ``scored``."""
    return scored(docs, fitted(docs, labels))
