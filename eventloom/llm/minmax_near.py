"""Near duplicates by min-max hashing.

Each hash function is evaluated once over a document's set of word shingles and gives two signature values, its minimum and its
maximum, so half as many evaluations are needed. The values are cut into bands; documents that agree on a whole band meet in a
bucket. Sets that are equal are one class and only its representative takes part.

Links are found in rounds. First every member of a bucket is compared with the bucket's smallest id: a star, not all pairs.
Its confirmed links join most members; only buckets that still hold several components are looked at again, where members of
different components are compared by their signatures (a band's first bucket speaks for a pair, so a pair comes once) and by
their parities: of the shingles in each of some thousand cells, whether their number is odd. Cells that differ are at most as many
as shingles that differ, so parities lose no link, and since there are several cells to a shingle few pairs pass that are none;
those are confirmed on the full sets. Large buckets are dealt out in pairs of blocks. Before that, a round over neighbouring blocks
joins what is alike in them by as many pairs as join components, so that members that are all linked with each other, but not with the
bucket's smallest id, do not come as all pairs. With the parameters below a pair at the threshold shares no band with a
probability of 1e-6, and fails the signature test with about as little.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.components import components, merged
from eventloom.llm.shared import id_or_none, texts, written
from eventloom.llm.words import _table, mix, window_hashes, word_hashes

SHINGLE = 5
BANDS, ROWS = 36, 7  # 252 values from 126 hash functions
BLOCK = 512
#: Buckets of more members than this are first joined by a round of few pairs.
LARGE = 64
#: Cells of a set's parities: the power of two from CELLS times its size on, within these bounds.
CELLS, LEAST_CELLS, MOST_CELLS = 4, 64, 1 << 17
#: A pair whose signatures agree less than this is not compared in full: 4.4 standard deviations below 0.85.
LIKELY = 0.75

_FACTORS = _table("factor", BANDS * ROWS // 2) | np.uint64(1)
_SHIFTS = _table("shift", BANDS * ROWS // 2)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's distinct shingles of k words, sorted; of fewer words the whole sequence is the only one."""
    h, _, _ = word_hashes(text, lower=True)
    if 0 < len(h) < k:
        return window_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(window_hashes(h, k))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte for each signature value of each non-empty set: minimum and maximum of every hash function side by side."""
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), BANDS * ROWS), np.uint8)
    for j in range(BANDS * ROWS // 2):
        v = (flat ^ _SHIFTS[j]) * _FACTORS[j]
        v ^= v >> np.uint64(32)
        for side, how in enumerate((np.minimum, np.maximum)):
            out[:, 2 * j + side] = mix(how.reduceat(v, at)) >> np.uint64(56)
    return out


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's members fall into each cell, 64 cells in a word."""
    cells = min(max(1 << (CELLS * len(s) - 1).bit_length(), LEAST_CELLS), MOST_CELLS)
    odd = np.bincount((mix(s) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<u8")


def _folded(p: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer cells, of one set or of several (rows)."""
    while p.shape[-1] > words:
        half = p.shape[-1] // 2
        p = p[..., :half] ^ p[..., half:]
    return p


def apart(p: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Cells in which parities differ from each of ``others``: no more than there are members in one set alone."""
    out, length = np.zeros(len(others), np.int64), np.array([len(o) for o in others])
    for n in np.unique(length):
        at, least = np.flatnonzero(length == n), min(n, len(p))
        out[at] = np.bitwise_count(_folded(np.stack([others[k] for k in at]), least) ^ _folded(p, least)).sum(axis=1)
    return out


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingles(t) for t in pdf["_text"]]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(sets)
        odd: list[bytes | None] = [None] * len(sets)
        one, two = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full])):
                sig[i] = row.tobytes()
            for i in full:  # a name for the set: two sums over its members
                one[i] = np.bitwise_xor.reduce(mix(sets[i])).view(np.int64)
                two[i] = np.add.reduce(mix(sets[i] ^ np.uint64(0x5BF03635))).view(np.int64)
                odd[i] = parities(sets[i]).tobytes()
        yield pd.DataFrame({"_id": pdf["_id"], "_n": [len(s) for s in sets], "_s1": one, "_s2": two, "_sig": sig, "_odd": odd})


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        sig = np.frombuffer(b"".join(pdf["_sig"]), np.uint8).reshape(len(pdf), BANDS, ROWS)
        key = np.zeros((len(pdf), BANDS, 8), np.uint8)
        key[:, :, 1:] = sig
        key[:, :, 0] = np.arange(BANDS)
        yield pd.DataFrame({"_key": key.reshape(-1).view(np.int64), "_id": np.repeat(pdf["_id"].to_numpy(), BANDS), "_n": np.repeat(pdf["_n"].to_numpy(), BANDS)})


def _comparable(a: str, b: str, percent: int) -> F.Column:
    """Sets whose sizes alone do not rule the similarity out."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * shared >= percent * union, on the full sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(i: int, text: str) -> np.ndarray:
            if i not in known:
                known[i] = shingles(text)
                if len(known) > 200:
                    known.popitem(last=False)
            return known[i]

        for pdf in batches:
            keep = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["_ta"], pdf["_tb"]):
                x, y = of(a, ta), of(b, tb)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pdf.loc[keep, ["a", "b"]]

    one = docs.select(F.col("_id").alias("a"), F.col("_text").alias("_ta"))
    two = docs.select(F.col("_id").alias("b"), F.col("_text").alias("_tb"))
    return pairs.join(two, "b").join(one, "a").mapInPandas(check, "a bigint, b bigint")


def _joined(parent: dict[int, int], a: int, b: int) -> bool:
    """Join the groups of a and b; false where they are one already."""

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    a, b = top(a), top(b)
    parent[a] = b
    return a != b


def _unlinked(percent: int, few: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Pairs of a block pair's members in different components that may be similar; each in the first bucket it shares. few: only such as join components."""

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(np.array([key[0]], np.int64).view(np.uint8)[0])
        pdf = pdf.sort_values("_id")
        left = pdf[pdf["_block"] == key[1]]
        right = pdf[pdf["_block"] == key[2]]
        sig_l, sig_r = (np.frombuffer(b"".join(x["_sig"]), np.uint8).reshape(len(x), BANDS * ROWS) for x in (left, right))
        odd_l, odd_r = ([np.frombuffer(o, "<u8") for o in x["_odd"]] for x in (left, right))
        id_r, comp_r, n_r, low = right["_id"].to_numpy(), right["_comp"].to_numpy(), right["_n"].to_numpy(), pdf["_low"].to_numpy()[0]
        out_a, out_b, parent = [], [], {}
        for i, (a, comp, n) in enumerate(zip(left["_id"], left["_comp"], left["_n"])):
            if a == low:
                continue
            may = (comp_r != comp) & (id_r != low) & (np.minimum(n_r, n) * 100 >= np.maximum(n_r, n) * percent)
            if key[1] == key[2]:
                may &= id_r > a
            at = np.flatnonzero(may)
            if not len(at):
                continue
            same = sig_r[at] == sig_l[i]
            ok = same.mean(axis=1) >= LIKELY
            ok &= same.reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            at = at[ok]
            at = at[(100 + percent) * apart(odd_l[i], [odd_r[k] for k in at]) <= (100 - percent) * (n_r[at] + n)]
            for b, other in zip(id_r[at], comp_r[at]):
                if not few or _joined(parent, comp, other):
                    out_a.append(min(a, b))
                    out_b.append(max(a, b))
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})

    return pairs


def _again(shared: DataFrame, reps: DataFrame, found: DataFrame, percent: int, few: bool) -> DataFrame:
    """Pairs (a, b) in buckets that hold several components yet; few: in neighbouring blocks of large ones, and only such as join components."""
    seen = shared.join(found.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("_comp", F.coalesce("component", "_id"))
    open_ = seen.groupBy("_key").agg(F.min("_comp").alias("_x"), F.max("_comp").alias("_y")).where("_x < _y").select("_key")
    again = seen.join(open_, "_key", "left_semi").where(F.col("_m") > (LARGE if few else 2))
    again = again.join(reps.select("_id", "_sig", "_odd"), "_id").withColumn("_blocks", F.ceil(F.col("_m") / BLOCK).cast("int"))
    again = again.withColumn("_block", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    if few:
        other = F.explode(F.sequence(F.greatest(F.lit(0), F.col("_block") - 1), F.least(F.col("_blocks") - 1, F.col("_block") + 1)))
    else:
        other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    again = again.withColumn("_other", other).select("_key", F.least("_block", "_other").alias("_p"), F.greatest("_block", "_other").alias("_q"), "_block", "_id", "_n", "_comp", "_low", "_sig", "_odd")
    return again.groupBy("_key", "_p", "_q").applyInPandas(_unlinked(percent, few), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * shared >= percent * union of their shingle sets, and a component is what links reach; it is
    named by its smallest doc_id, and that row is kept. Null and blank texts have an empty set and stand alone. A null doc_id
    counts as one id below all others and is given back as null; rows that repeat an id get its component each, and where they
    differ in text each keeps its own size. Other columns are ignored; an empty table gives an empty table.
    """
    rows = texts(docs)
    sets = written(rows.mapInPandas(_sketch, "_id bigint, _n bigint, _s1 bigint, _s2 bigint, _sig binary, _odd binary"), "minmax")
    classes = sets.where("_n > 0").groupBy("_s1", "_s2", "_n").agg(F.min("_id").alias("_rep"))
    member = sets.where("_n > 0").select("_id", "_n", "_s1", "_s2").join(classes, ["_s1", "_s2", "_n"]).select("_id", "_n", "_rep")
    reps = sets.join(classes.select("_s1", "_s2", "_n", F.col("_rep").alias("_id")), ["_s1", "_s2", "_n", "_id"], "left_semi").dropDuplicates(["_id", "_s1", "_s2"])
    keys = reps.select("_id", "_n", "_sig").mapInPandas(_band_keys, "_key bigint, _id bigint, _n bigint")
    stars = keys.groupBy("_key").agg(F.min(F.struct("_id", "_n")).alias("_c"), F.count("*").alias("_m")).where("_m > 1")
    shared = written(keys.join(stars.select("_key", F.col("_c._id").alias("_low"), F.col("_c._n").alias("_low_n"), "_m"), "_key"), "buckets")
    first = shared.where((F.col("_id") != F.col("_low")) & _comparable("_n", "_low_n", percent)).select(F.col("_low").alias("a"), F.col("_id").alias("b")).distinct()
    links = written(confirmed(first, rows, percent).distinct(), "links")
    found = components(links)
    for few in (True, False):
        more = written(confirmed(_again(shared, reps, found, percent, few), rows, percent).distinct(), "links")
        found = found if more.isEmpty() else merged(found, more)
    comp = member.join(found.select(F.col("node").alias("_rep"), "component"), "_rep", "left").select("_id", "_n", F.coalesce("component", "_rep").alias("_c"))
    whole = comp.unionByName(sets.where("_n = 0").select("_id", "_n", F.col("_id").alias("_c")))
    return whole.select(id_or_none("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), id_or_none("_c").alias("component_id"), (F.col("_id") == F.col("_c")).alias("kept"))
