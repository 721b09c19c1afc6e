"""Repeated word windows removed, with a count-min sketch as prefilter.

First pass: every task sketches its windows as two rows of counters that saturate at two, held as bitmaps "seen" and "seen
again"; sketches are merged block by block with bit operations. The merged counts never fall below the true ones. Second pass:
only windows estimated to repeat are grouped exactly, by a 96-bit hash of their words. A task keeps the earliest start of each window
among its own rows, so that a window found everywhere reaches the grouping once per task; later starts are known to be removed.

The sketch has a fixed upper size (2 bitmaps of 2**MOST_BITS bits are broadcast, 64 MB), so on inputs far above 100 million
windows it lets ever more windows through; the result is the same, the grouping does the rest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, texts
from eventloom.llm.words import mix, window_hashes, word_hashes, words_of

WINDOW = 20
LEAST_BITS, MOST_BITS, BLOCKS = 16, 28, 128
#: Windows that a task gathers before it looks at them.
CHUNK = 1_000_000
#: Buckets of documents for each shuffle partition, by which starts to be removed are gathered.
BUCKETS = 4


def _cells(w: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The counter of a window in a row of the sketch."""
    return (w >> np.uint64(64 - bits)) if row == 0 else (w & np.uint64((1 << bits) - 1))


def _marked(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _mark(bitmap: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of sorted cells."""
    if len(cells):
        byte = cells >> np.uint64(3)
        first = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        bitmap[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (cells & np.uint64(7)).astype(np.uint8), first)


def _add(once: np.ndarray, twice: np.ndarray, cells: np.ndarray) -> None:
    cells = np.sort(cells)
    again = np.concatenate(([False], cells[1:] == cells[:-1]))
    _mark(twice, cells[again])
    single = cells[~again]
    _mark(twice, single[_marked(once, single)])
    _mark(once, single)


def _sketch(batches: Iterator[pd.DataFrame], window: int, bits: int) -> Iterator[pd.DataFrame]:
    once, twice = np.zeros((2, (1 << bits) // 8), np.uint8), np.zeros((2, (1 << bits) // 8), np.uint8)
    held, size = [], 0

    def take() -> None:
        w = np.concatenate(held)
        for row in (0, 1):
            _add(once[row], twice[row], _cells(w, row, bits))

    for pdf in batches:
        for text in pdf["_text"]:
            w = window_hashes(word_hashes(text)[0], window)
            if len(w):
                held.append(w)
                size += len(w)
            if size >= CHUNK:
                take()
                held, size = [], 0
    if size:
        take()
    one, two = once.reshape(2 * BLOCKS, -1), twice.reshape(2 * BLOCKS, -1)
    for k in range(2 * BLOCKS):
        if one[k].any():
            yield pd.DataFrame({"block": [k], "once": [_gaps(one[k])], "twice": [_gaps(two[k])]})


def _gaps(bitmap: np.ndarray) -> bytes:
    """A sparse bitmap as the gaps between its bits, a byte each; 255 stands for 255 and goes on."""
    at = np.flatnonzero(np.unpackbits(bitmap, bitorder="little"))
    gap = np.diff(at, prepend=0)
    past = np.cumsum(gap // 255 + 1)
    out = np.full(past[-1] if len(past) else 0, 255, np.uint8)
    out[past - 1] = gap % 255
    return out.tobytes()


def _bits(gaps: bytes) -> np.ndarray:
    """Where the bits of such a bitmap are."""
    gap = np.frombuffer(gaps, np.uint8)
    return np.cumsum(gap, dtype=np.int64)[gap < 255]


def _merge(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Add the sketches' blocks, which come sorted by block; one block is held at a time."""
    block, once, twice = None, np.zeros(8 * width, bool), np.zeros(8 * width, bool)
    done = lambda: pd.DataFrame({"block": [block], "twice": [zlib.compress(np.packbits(twice, bitorder="little"), 1)]})
    for pdf in batches:
        for k, one, two in zip(pdf["block"], pdf["once"], pdf["twice"]):
            if k != block:
                if block is not None:
                    yield done()
                block, once, twice = k, np.zeros(8 * width, bool), np.zeros(8 * width, bool)
            at = _bits(one)
            twice[at[once[at]]] = True
            once[at] = True
            twice[_bits(two)] = True
    if block is not None:
        yield done()


def sketch_bits(characters: int) -> int:
    """Bits of a row's address: about twice as many counters as there may be windows, between the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, int(max(1, characters) / 3).bit_length()))


def _starts(batches: Iterator[pd.DataFrame], window: int, bits: int, sketch) -> Iterator[pd.DataFrame]:
    """Of windows estimated to repeat: a task's earliest start each (for the grouping), and its later ones (to be removed)."""
    twice = [np.frombuffer(zlib.decompress(x), np.uint8) for x in sketch.value]
    held: list[tuple] = []
    size = 0

    def look() -> Iterator[pd.DataFrame]:
        one, two, doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, doc, two, one))
        one, two, doc, at = one[order], two[order], doc[order], at[order]
        fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        later = (doc != doc[first]) | (at != at[first])  # a row given twice is not earlier than itself
        yield pd.DataFrame({"_key": one[fresh].view(np.int64), "_more": (two[fresh].astype(np.int64) << 32) | at[fresh], "_id": doc[fresh], "_starts": None})
        yield _spread(doc[later], at[later])

    for pdf in batches:
        for i, text in zip(pdf["_id"], pdf["_text"]):
            h = word_hashes(text)[0]
            w = window_hashes(h, window)
            if not len(w):
                continue
            at = np.flatnonzero(_marked(twice[0], _cells(w, 0, bits)) & _marked(twice[1], _cells(w, 1, bits)))
            if len(at):
                held.append((w[at], (window_hashes(h, window, 2)[at] >> np.uint64(33)).astype(np.uint32), np.full(len(at), i), at))
                size += len(at)
            if size >= CHUNK:
                yield from look()
                held, size = [], 0
    if size:
        yield from look()


def _spread(doc: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Starts gathered by document, as bytes; the key deals them out evenly."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order].astype("<i4")
    cut = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    parts = [x.tobytes() for x in np.split(at, cut)] if len(doc) else []
    ids = doc[np.concatenate(([0], cut)).astype(int)] if len(doc) else doc
    return pd.DataFrame({"_key": ids * 0x61C8864F + 1, "_more": np.zeros(len(ids), np.int64), "_id": ids, "_starts": parts})


def _packed(doc: np.ndarray, at: np.ndarray, buckets: int) -> pd.DataFrame:
    """Starts gathered by bucket of documents: a row a bucket, with its documents, how many starts each has, and the starts."""
    bucket = (mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((at, doc, bucket))
    bucket, doc, at = bucket[order], doc[order], at[order].astype("<i4")
    fresh = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else [])
    counts = np.diff(fresh, append=len(doc)).astype("<i4")
    ids, of = doc[fresh].astype("<i8"), bucket[fresh]
    edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(of) else np.zeros(1, np.int64)
    ends = np.concatenate((fresh, [len(doc)]))
    rows = [(int(of[x]), ids[x:y].tobytes(), counts[x:y].tobytes(), at[ends[x] : ends[y]].tobytes()) for x, y in zip(edge[:-1], edge[1:])]
    return pd.DataFrame(rows, columns=["_bucket", "_docs", "_counts", "_ats"])


def _later(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by window, document and start: all but the first of each window are removed. They leave a task by bucket."""
    one, two, doc, at = (np.zeros(0, np.int64),) * 4
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pdf in batches:
        known = pdf[pdf["_starts"].notna()]
        if len(known):
            starts = np.frombuffer(b"".join(known["_starts"]), "<i4").astype(np.int64)
            held.append((np.repeat(known["_id"].to_numpy(), known["_starts"].map(len).to_numpy() // 4), starts))
            size += len(starts)
        pdf = pdf[pdf["_starts"].isna()]
        if len(pdf):
            more = pdf["_more"].to_numpy()
            # the last window's earliest row leads the next batch, so that its later rows are still known
            o, w, d, a = (np.concatenate((x[:1], y)) for x, y in zip((one, two, doc, at), (pdf["_key"].to_numpy(), more >> 32, pdf["_id"].to_numpy(), more & 0xFFFFFFFF)))
            fresh = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])))
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            out = (d != d[first]) | (a != a[first])
            held.append((d[out], a[out]))
            size += int(out.sum())
            k = first[-1]
            one, two, doc, at = o[k : k + 1], w[k : k + 1], d[k : k + 1], a[k : k + 1]
        if size >= CHUNK:
            yield _packed(*(np.concatenate(x) for x in zip(*held)), buckets)
            held, size = [], 0
    if size:
        yield _packed(*(np.concatenate(x) for x in zip(*held)), buckets)


def _by_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed rows sorted by bucket: each document's starts, as runs (first, one past the last); one bucket is held at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = None

    def runs() -> pd.DataFrame:
        doc, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order].astype(np.int64)
        again = np.concatenate(([False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])))
        doc, at = doc[~again], at[~again]
        head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))))
        tail = np.concatenate((head[1:], [len(doc)])) - 1
        pairs, of = np.stack((at[head], at[tail] + 1), 1).astype("<i4"), doc[head]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        return pd.DataFrame({"_id": of[cut], "_runs": [x.tobytes() for x in np.split(pairs, cut[1:])]})

    for pdf in batches:
        for k, docs, counts, ats in zip(pdf["_bucket"], pdf["_docs"], pdf["_counts"], pdf["_ats"]):
            if k != bucket and held:
                yield runs()
                held = []
            bucket = k
            held.append((np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<i4")), np.frombuffer(ats, "<i4")))
    if held:
        yield runs()


def _cover(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, runs in zip(pdf["_id"], pdf["_text"], pdf["_runs"]):
            words = words_of(text)
            kept = words
            if runs is not None and len(runs):
                step = np.zeros(len(words) + 1, np.int64)
                first, past = np.frombuffer(runs, "<i4").reshape(-1, 2).T
                # starts beyond the last window can only come from another text with this id
                past = np.minimum(past, len(words) - window + 1)
                first, past = first[first < past], past[first < past]
                np.add.at(step, first, 1)
                np.add.at(step, past + window - 1, -1)
                covered = np.cumsum(step)[:-1] > 0
                kept = [w for w, c in zip(words, covered) if not c]
            joined = b" ".join(kept)
            rows.append((i, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")))
        yield pd.DataFrame(rows, columns=["_id", "n_words", "n_removed", "kept_sha256", "kept"])


def repeated_windows_removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    A word is removed when a window of ``window`` words covers it whose words also start earlier: in a smaller doc_id, or in the
    same document before. ``kept`` is what is left, joined by one space. Words are runs without ASCII white space, unchanged.
    Null and blank texts have no words. A null doc_id counts as one id below all others; rows that repeat an id with the same text
    are one document and treated alike (rows that share an id with other texts are out of scope: their windows are judged
    together). Other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = texts(docs)
    characters = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    bits = sketch_bits(characters)
    width = (1 << bits) // 8 // BLOCKS
    own = rows.select("_text").mapInPandas(lambda b: _sketch(b, window, bits), "block int, once binary, twice binary")
    merged = own.repartition(2 * BLOCKS, "block").sortWithinPartitions("block").mapInPandas(lambda b: _merge(b, width), "block int, twice binary")
    blocks = {r["block"]: zlib.decompress(r["twice"]) for r in merged.collect()}
    sketch = spark.sparkContext.broadcast([zlib.compress(b"".join(blocks.get(row * BLOCKS + k, bytes(width)) for k in range(BLOCKS)), 1) for row in (0, 1)])
    del blocks
    found = rows.mapInPandas(lambda b: _starts(b, window, bits, sketch), "_key bigint, _more bigint, _id bigint, _starts binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(tasks, "_key").sortWithinPartitions("_key", F.shiftright("_more", 32), "_id", "_more")
    packed = dealt.mapInPandas(lambda b: _later(b, BUCKETS * tasks), "_bucket int, _docs binary, _counts binary, _ats binary")
    removed = packed.repartition(tasks, "_bucket").sortWithinPartitions("_bucket").mapInPandas(_by_document, "_id bigint, _runs binary")
    out = rows.join(removed, "_id", "left").mapInPandas(lambda b: _cover(b, window), "_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    return out.select(id_or_none("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept")
