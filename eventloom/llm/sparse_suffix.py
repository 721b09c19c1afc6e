"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected places are kept: a place is kept when the hash of its K words is the least of some SPAN
neighbouring ones. Two copies of a passage keep the same places inside it, and a passage of ``least`` words keeps one among its
first SPAN places, so that at least SEED words follow there inside the passage. Suffixes whose first SEED words are unique in
the corpus are dropped by a count; the rest carry the hashed words around their place, are dealt out by range and sorted by what
follows. Neighbours in that order, among those that agree on 0, 1, 2 ... words to the left, are compared, which finds for every
length to the left the longest match to the right. Matches are extended both ways word by word, and those of ``least`` words or more count;
the places of a long passage overlap, so their extended matches join up to the whole of it.

Where a seed has too many suffixes to be sorted in one task, the windows of LEAST words around their places are dealt by their
hashes instead, and those that stand in two documents are matches: any match holds such windows, which join up to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, texts
from eventloom.llm.words import sliding, window_hashes, word_hashes

K = 8
LEAST = 50
SPAN = 19
SEED = LEAST - SPAN + 1
#: Words carried to the left and to the right of a place, and bytes that stand for a word.
LEFT, RIGHT, WIDTH = SPAN - 1, LEAST, 4
#: Suffixes with one seed up to which they are sorted in one task; larger groups are met by their windows.
GROUP_ROWS = 100_000
#: Rows that a task compares at a time, and rows of a group carried over.
CHUNK = 50_000


def places(h: np.ndarray) -> np.ndarray:
    """Places of a text's words at which suffixes are kept, with SEED words to follow."""
    g = window_hashes(h, K)
    low = sliding(g, SPAN, np.minimum)
    if not len(low):
        return np.zeros(0, np.int64)
    padded = np.concatenate((np.zeros(SPAN - 1, np.uint64), low, np.zeros(SPAN - 1, np.uint64)))
    kept = np.flatnonzero(g == sliding(padded, SPAN, np.maximum)[: len(g)])
    return kept[kept + SEED <= len(h)]


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for i, text in zip(pdf["_id"], pdf["_text"]):
            h, _, _ = word_hashes(text)
            if len(h) < LEAST:
                continue
            p = places(h)
            ids.append(np.full(len(p), i))
            at.append(p.astype(np.int32))
            seed.append(window_hashes(h, SEED)[p].view(np.int64))
        yield pd.DataFrame({"_id": np.concatenate(ids), "_at": np.concatenate(at), "_seed": np.concatenate(seed)})


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For the kept places of a text: the words to the left, nearest first, and to the right, as comparable bytes.

    Around places whose seed has too many suffixes: the windows of LEAST words that hold the place among their first SPAN words.
    """
    for pdf in batches:
        rows: list[tuple] = []
        for i, text, kept in zip(pdf["_id"], pdf["_text"], pdf["_kept"]):
            h, _, _ = word_hashes(text)
            w = (h >> np.uint64(32)).astype(">u4")
            raw, back = w.tobytes(), w[::-1].tobytes()
            n = len(w)
            hot = [k["_at"] for k in kept if k["_hot"]]
            for k in kept:
                p = k["_at"]
                if k["_hot"]:
                    continue
                left = back[(n - p) * WIDTH : (n - p + LEFT) * WIDTH]
                right = raw[p * WIDTH : (p + RIGHT) * WIDTH]
                rows.append((i, p, k["_seed"], b"", left, right))
            if hot and n >= LEAST:
                one, two = window_hashes(h, LEAST).view(np.int64), window_hashes(h, LEAST, 2)
                around = np.unique(np.add.outer(hot, np.arange(-LEFT, 1)))
                for q in around[(around >= 0) & (around < len(one))].tolist():
                    # in order of window, id and place; ids are shifted so that their bytes sort as they do
                    rows.append((i, q, one[q], two[q].tobytes() + (i + (1 << 63)).to_bytes(8, "big") + q.to_bytes(4, "big"), None, None))
        yield pd.DataFrame(rows, columns=["_id", "_at", "_seed", "_cut", "_left", "_right"])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row of x and y."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def _matrix(parts: pd.Series, words: int, side: int) -> np.ndarray:
    """Rows of word codes; where the text ends, each row has a code of its own kind that matches none."""
    width = words * WIDTH
    codes = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), ">u4").reshape(len(parts), words).astype(np.int64)
    have = np.array([len(p) // WIDTH for p in parts])
    beyond = np.arange(words) >= have[:, None]
    return np.where(beyond, -1 - 2 * np.arange(len(parts))[:, None] - side, codes)


def _neighbours(key: np.ndarray, own: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest rows, in the sorted order, that have one key and differ in ``own``."""
    by = np.argsort(key, kind="stable")
    k, o, n = key[by], own[order[by]], len(by)
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])))
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    before, after = first[run] - 1, np.concatenate((first[1:], [n]))[run]
    here = np.arange(n)
    low, high = (before >= 0) & (k[before] == k), (after < n) & (after != here + 1)
    high &= k[np.minimum(after, n - 1)] == k
    return order[by[np.concatenate((before[low], here[high]))]], order[by[np.concatenate((here[low], after[high]))]]


def _repeats(pdf: pd.DataFrame, within: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Spans of sorted windows that stand in two documents (``within``: or at two places of one), and the last window's rows of its smallest id."""
    ids, at = pdf["_id"].to_numpy(np.int64), pdf["_at"].to_numpy(np.int64)
    window = np.stack((pdf["_seed"].to_numpy(np.int64), np.frombuffer(b"".join(c[:8] for c in pdf["_cut"]), np.int64)))
    new = np.concatenate(([True], (window[:, 1:] != window[:, :-1]).any(axis=0)))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    last = np.append(np.flatnonzero(new)[1:], len(ids))[np.cumsum(new) - 1] - 1
    low, high = ids[first], ids[last]
    beyond = np.minimum.reduceat(np.where(ids != low, ids, np.iinfo(np.int64).max), np.flatnonzero(new))[np.cumsum(new) - 1]
    partner = np.where(ids != low, low, beyond)
    hit = low != high
    if within:
        twice = (ids == low) & (np.maximum.reduceat(np.where(ids == low, at, -1), np.flatnonzero(new))[np.cumsum(new) - 1] != at[first])
        partner, hit = np.where(twice, low, partner), hit | twice
    held = pdf[(first == first[-1]) & (ids == low)].drop_duplicates(["_id", "_at"])
    return pd.DataFrame({"_id": ids[hit], "_from": at[hit], "_to": at[hit] + LEAST, "_with": partner[hit]}), held


def _matches(batches: Iterator[pd.DataFrame], least: int, within: bool) -> Iterator[pd.DataFrame]:
    """Spans of matches between sorted suffixes; the rows of the last seed are carried over to the next chunk."""
    held: list[pd.DataFrame] = []
    windows: pd.DataFrame | None = None
    fresh = 0

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at, seed = pdf["_id"].to_numpy(), pdf["_at"].to_numpy(), pdf["_seed"].to_numpy()
        left, right = _matrix(pdf["_left"], LEFT, 0), _matrix(pdf["_right"], RIGHT, 1)
        order = np.lexsort((*right.T[::-1], seed))
        group = np.cumsum(np.concatenate(([0], seed[order][1:] != seed[order][:-1])))
        key = group.astype(np.uint64)
        begin, end, other = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64), np.full(len(pdf), -1)
        for o in range(LEFT + 1):
            if o:
                key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ left[order, o - 1].astype(np.uint64)
                key ^= key >> np.uint64(29)
            x, y = _neighbours(key, ids if not within else ids * 1_000_003 + at, order)
            if not len(x):
                continue
            r = _common(right[x], right[y])
            l = _common(left[x], left[y])
            long = l + r >= least
            for a, b in ((x[long], y[long]), (y[long], x[long])):
                np.maximum.at(begin, a, l[long])
                np.maximum.at(end, a, r[long])
                other[a] = b
        hit = np.flatnonzero(other >= 0)
        return pd.DataFrame({"_id": ids[hit], "_from": at[hit] - begin[hit], "_to": at[hit] + end[hit], "_with": ids[other[hit]]})

    for pdf in batches:
        hot = pdf["_left"].isna()
        if hot.any():
            found, windows = _repeats(pdf[hot] if windows is None else pd.concat((windows, pdf[hot]), ignore_index=True), within)
            yield found
            pdf = pdf[~hot]
        held.append(pdf)
        fresh += len(pdf)
        if fresh >= CHUNK:
            whole = pd.concat(held, ignore_index=True)
            yield compare(whole)
            held, fresh = [whole[whole["_seed"] == whole["_seed"].iloc[-1]]], 0
    if fresh:
        yield compare(pd.concat(held, ignore_index=True))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, spans, partner in zip(pdf["_id"], pdf["_spans"], pdf["_with"]):
            whole: list[list[int]] = []
            for s, e in sorted((x["_from"], x["_to"]) for x in spans):
                if whole and s <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            rows.append((i, len(whole), sum(e - s for s, e in whole), ",".join(f"{s}:{e}" for s, e in whole), partner))
        yield pd.DataFrame(rows, columns=["_id", "n_spans", "n_words", "spans", "_with"])


def repeated_passages(docs: DataFrame, within: bool = False) -> DataFrame:
    """(doc_id, n_spans, n_words, spans, partner_doc_id) of every document of ``docs`` (doc_id, text) with a passage of LEAST or
    more words that also stands in another document (``within``: or elsewhere in its own).

    ``spans`` are word positions "first:past the last" of the repeated stretches, joined by commas where they touch or overlap;
    ``partner_doc_id`` is the smallest other id met in a comparison. Words are runs without ASCII white space, compared unchanged.
    Null, blank and short texts give no row; a null doc_id counts as one id; rows that repeat an id are one document here; other
    columns are ignored; an empty table gives an empty table.
    """
    rows = texts(docs)
    kept = rows.mapInPandas(_seeds, "_id bigint, _at int, _seed bigint")
    often = kept.groupBy("_seed").agg(F.count("*").alias("_m")).where("_m > 1")
    shared = kept.join(often, "_seed").groupBy("_id").agg(F.collect_list(F.struct("_at", "_seed", (F.col("_m") > GROUP_ROWS).alias("_hot"))).alias("_kept"))
    around = rows.join(shared, "_id").mapInPandas(_contexts, "_id bigint, _at int, _seed bigint, _cut binary, _left binary, _right binary")
    dealt = around.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_seed").sortWithinPartitions("_seed", "_cut")
    spans = dealt.mapInPandas(lambda b: _matches(b, LEAST, within), "_id bigint, _from int, _to int, _with bigint")
    by_doc = spans.groupBy("_id").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans"), F.min("_with").alias("_with"))
    out = by_doc.mapInPandas(_joined, "_id bigint, n_spans bigint, n_words bigint, spans string, _with bigint")
    return out.select(id_or_none("_id").alias("doc_id"), "n_spans", "n_words", "spans", id_or_none("_with").alias("partner_doc_id"))
