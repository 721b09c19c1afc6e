"""Packing of documents into sequences by minimum bin slack.

A document's ids are cut into whole sequences and one rest. The rests of all documents are a multiset of lengths below the
capacity, so its histogram is small whatever the corpus. Sequences are planned on the histogram: the longest length left opens a
sequence, and subset sums of the remaining multiset, kept as the bits of one integer, show how close the room can be filled;
the counts are traced back, and the pattern is used as often as the lengths left allow. Rests then take the places of their length
in order of rank; ranks come from counts by group and length, so no length is numbered in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.coder import coder
from eventloom.llm.shared import id_or_none, texts, written

CAPACITY = 4096
#: Pieces that are ranked together.
GROUP_PIECES = 20_000


def fill(room: int, counts: dict[int, int]) -> dict[int, int]:
    """A multiset of the counted lengths with the largest sum up to ``room``."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # what could be reached before adding so many of a length
    for length in sorted((x for x in counts if x <= room), reverse=True):
        most, power = min(counts[length], room // length), 1
        while most > 0:
            n = min(power, most)
            more = (reach | (reach << (n * length))) & mask
            if more != reach:
                steps.append((length, n, reach))
                reach = more
            most, power = most - n, 2 * power
        if reach >> room:
            break
    target, used = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> target & 1:
            used[length] = used.get(length, 0) + n
            target -= n * length
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences as multisets of lengths, and how often each is used; every counted length is used up."""
    left, out = dict(counts), []
    while left:
        first = max(left)
        left[first] -= 1
        rest = {k: v for k, v in left.items() if v}
        used = fill(capacity - first, rest)
        used[first] = used.get(first, 0) + 1
        left[first] += 1
        times = min(left[k] // n for k, n in used.items())
        out.append((used, times))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows of first rank, number in a sequence, offset of the first of them, first sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.setdefault(length, []).append((taken.get(length, 0), used[length], offset, sequence))
            taken[length] = taken.get(length, 0) + used[length] * times
            offset += used[length] * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of every row of ``docs`` (doc_id, text).

    A null text counts as empty and is the end id alone. Rows with null or repeated ids are pieces of their own; other columns
    are ignored; an empty table gives an empty table. Sequences hold no more than ``capacity`` ids, gapless from 0.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(tokenizer, end_id)
        for pdf in batches:
            rows = []
            for i, ids in zip(pdf["_id"], own.encode(list(pdf["_text"]))):
                raw = ids.astype("<u4")
                for at in range(0, len(raw), capacity):
                    part = raw[at : at + capacity]
                    rows.append((i, at, len(part), zlib.crc32(part.tobytes()), len(raw)))
            yield pd.DataFrame(rows, columns=["_id", "_start", "_length", "_crc", "_tokens"])

    schema = "_id bigint, _start bigint, _length bigint, _crc bigint, _tokens bigint"
    pieces = written(texts(docs).mapInPandas(cut, schema), "pieces")
    histogram = {r["_length"]: r["n"] for r in pieces.groupBy("_length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    table = places(patterns(histogram, capacity)) if histogram else {}
    send = docs.sparkSession.sparkContext.broadcast(table)
    groups = sum(histogram.values()) // GROUP_PIECES + 1
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "_start", "_crc"), F.lit(groups)))
    counts = grouped.groupBy("_group", "_length").agg(F.count("*").alias("_n"))
    before = counts.select("_group", "_length", (F.sum("_n").over(Window.partitionBy("_length").orderBy("_group")) - F.col("_n")).alias("_before"))
    ranked = grouped.withColumn("_row", F.row_number().over(Window.partitionBy("_group", "_length").orderBy("_id", "_start", "_crc")) - 1)
    ranked = ranked.join(before, ["_group", "_length"]).select("_id", "_start", "_length", "_crc", "_tokens", (F.col("_before") + F.col("_row")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            length, rank = pdf["_length"].to_numpy(), pdf["_rank"].to_numpy()
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                rows = send.value[size]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 3] + nth // row[:, 1]
                offset[at] = row[:, 2] + nth % row[:, 1] * size
            yield pd.DataFrame({"_id": pdf["_id"], "start": pdf["_start"], "length": length, "ids_crc32": pdf["_crc"], "doc_tokens": pdf["_tokens"], "sequence_id": sequence, "offset": offset})

    out = ranked.mapInPandas(place, "_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumn("_id", id_or_none("_id")).withColumnRenamed("_id", "doc_id")
