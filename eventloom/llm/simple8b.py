"""Token ids in Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of payload: the selector says how many ids of how many bits follow, from 240
zeros to one id of 60 bits. Ids of more bits are escaped: zero stands in the stream, place and value in a list. The stream is cut
into blocks of BLOCK ids with their first word's offset, so blocks are coded and decoded side by side as array operations.

A chunk is a self-contained run of bytes: header, document ids and lengths, block offsets, escapes, words. Chunks are numbered by
shard (a range of documents) and place in it; the ids of a chunk follow those of the one before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.coder import coder
from eventloom.llm.shared import id_or_none, texts
from eventloom.llm.words import sliding

# Fixed values of the code: ids in a word by selector, and their bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
CHUNK_IDS = 500_000
_HEADER = struct.Struct("<4sQQQQ")
_MAGIC = b"S8B1"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, offsets of the blocks' first words (and of the end), and the places of escaped ids."""
    values = np.asarray(ids).astype(np.uint64)
    escaped = np.flatnonzero(values >> np.uint64(60))
    values[escaped] = 0
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), escaped
    width = np.zeros(n, np.uint8)
    for bits in BITS[1:]:
        width[values >> np.uint64(bits) > 0] = bits + 1
    place = np.arange(n)
    left = np.minimum(n, (place // BLOCK + 1) * BLOCK) - place
    choice = np.full(n, len(COUNTS) - 1, np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):
        fits = sliding(width, COUNTS[s], np.maximum) <= BITS[s]
        fits &= left[: len(fits)] >= COUNTS[s]
        choice[: len(fits)][fits] = s
    step = COUNTS[choice]
    here, starts = np.arange(0, n, BLOCK), []
    past = np.minimum(here + BLOCK, n)
    while len(here):
        starts.append(here)
        here = here + step[here]
        going = here < past
        here, past = here[going], past[going]
    start = np.sort(np.concatenate(starts))
    selector = choice[start]
    words = selector.astype(np.uint64)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        for j in range(COUNTS[s] if BITS[s] else 0):
            words[at] |= values[start[at] + j] << np.uint64(4 + j * BITS[s])
    return words, np.searchsorted(start, np.arange(0, n + BLOCK, BLOCK).clip(max=n)).astype(np.uint32), escaped


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The ids of consecutive words, escapes as zeros."""
    selector = (words & np.uint64(15)).astype(np.int64)
    count = COUNTS[selector]
    start = np.cumsum(count) - count
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        for j in range(COUNTS[s] if BITS[s] else 0):
            out[start[at] + j] = (words[at] >> np.uint64(4 + j * BITS[s])) & np.uint64((1 << int(BITS[s])) - 1)
    return out


def chunk_bytes(doc_ids: list[int], ids: list[np.ndarray]) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    words, offsets, escaped = pack(flat)
    parts = [_HEADER.pack(_MAGIC, len(doc_ids), len(flat), len(words), len(escaped)), np.array(doc_ids, "<i8"), np.array([len(x) for x in ids], "<u8"), offsets.astype("<u4"), escaped.astype("<u8"), flat[escaped].astype("<u8"), words.astype("<u8")]
    return b"".join(bytes(p) if isinstance(p, bytes) else p.tobytes() for p in parts)


def read_chunk(raw: bytes, block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and the ids; with ``block`` only that block's ids are decoded."""
    magic, n_docs, n_ids, n_words, n_escaped = _HEADER.unpack_from(raw)
    if magic != _MAGIC:
        raise ValueError("not a chunk of ids")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    docs, lengths = take("<i8", n_docs), take("<u8", n_docs)
    offsets, places, values = take("<u4", -(-n_ids // BLOCK) + 1), take("<u8", n_escaped), take("<u8", n_escaped)
    words = take("<u8", n_words)
    first, n = 0, n_ids
    if block is not None:
        words, first = words[offsets[block] : offsets[block + 1]], block * BLOCK
        n = min(BLOCK, n_ids - first)
    ids = unpack(words, n)
    mine = (places >= first) & (places < first + n)
    ids[places[mine].astype(np.int64) - first] = values[mine]
    return docs, lengths, ids


_FILE = "shard int, chunk int, before bigint, n_ids bigint, content binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text of ``docs`` (doc_id, text), and write chunks in ascending doc_id order under ``path``.

    Documents are dealt out by ranges of doc_id, with the text's hash behind it, so rows that share an id (or have none) are spread
    too. A file is a Parquet container of chunks, written by Spark's own committing writer wherever ``path`` leads.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, shard = coder(tokenizer, end_id), TaskContext.get().partitionId()
        chunk = before = size = 0
        ids: list[int] = []
        coded: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "before": [before], "n_ids": [size], "content": [chunk_bytes(ids, coded)]})

        for pdf in batches:
            for i, x in zip(pdf["_id"], own.encode(list(pdf["_text"]))):
                ids.append(i)
                coded.append(x)
                size += len(x)
                if size >= CHUNK_IDS:
                    yield out()
                    chunk, before, size, ids, coded = chunk + 1, before + size, 0, [], []
        if ids:
            yield out()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs).withColumn("_tie", F.xxhash64("_text"))
    rows.repartitionByRange(n, "_id", "_tie").sortWithinPartitions("_id", "_tie").select("_id", "_text").mapInPandas(encode, _FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of every document in the files.

    ``start`` counts the ids of all documents before it: those of earlier shards, of earlier chunks of its shard, and in its chunk.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, before, raw in zip(pdf["shard"], pdf["before"], pdf["content"]):
                docs, lengths, ids = read_chunk(raw)
                past = np.cumsum(lengths).astype(np.int64)
                first = past - lengths.astype(np.int64)
                own = [ids[a:b].astype("<u4") for a, b in zip(first, past)]
                out = {"shard": shard, "_id": docs, "_at": before + first, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(x.tobytes()) for x in own]}
                yield pd.DataFrame(out | ({"ids": [x.astype(np.int64) for x in own]} if with_ids else {}))

    files = spark.read.schema(_FILE).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row for each shard, of which there are as many as shuffle partitions at most: bounded, so it is sent to every executor
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("_start"))
    more = ["ids"] if with_ids else []
    rows = files.select("shard", "before", "content").mapInPandas(decode, "shard int, _id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)
    return rows.join(F.broadcast(starts), "shard").select(id_or_none("_id").alias("doc_id"), (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32", *more)
