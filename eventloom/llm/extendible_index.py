"""Exact duplicates by an extendible-hash index on shared files, with DataFrame functions only.

Keys are 64-bit hashes of normalised texts. The directory has 2**g slots (the keys' first g bits); a bucket owns all slots that
begin with its prefix. Starting from one bucket, a bucket with more than CAPACITY keys is split by one more bit, doubling the
directory where needed; which splits that takes follows from counts of keys by slot, so it is one aggregation, not a loop over
the keys. Documents go to the bucket that the directory names for their key. There entries are made by comparing bytes, with the
smallest id and the number of rows; texts with one key but other bytes are chained. Equal texts are merged before they are shuffled, so
a text that fills a third of the table reaches its owner once per task. Owners write the index files by ranges of buckets, and
documents are looked up in theirs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.shared import id_or_none, new_path, texts, written

CAPACITY = 4096
MOST_DEPTH = 20


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space (single spaces, which stay, are not matched)."""
    return F.regexp_replace(text, r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(_slot, _depth, _bucket) for every slot that has keys, and the directory's depth; ``keys`` has distinct keys in ``_key``.

    A bucket's depth is the least at which its prefix holds at most ``capacity`` keys, or the directory's depth.
    """
    n = keys.count()
    deepest = min(MOST_DEPTH, max(0, math.ceil(math.log2(max(1, n) / capacity)) + 4)) if n > capacity else 0
    fine = written(keys.groupBy(_slot(F.col("_key"), deepest).alias("_slot")).agg(F.count("*").alias("_n")), "slots")
    levels = fine.withColumn("_depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    levels = levels.withColumn("_prefix", F.expr(f"shiftright(_slot, {deepest} - _depth)"))
    held = levels.groupBy("_depth", "_prefix").agg(F.sum("_n").alias("_keys"))
    fits = levels.join(held, ["_depth", "_prefix"]).where((F.col("_keys") <= capacity) | (F.col("_depth") == deepest))
    chosen = fits.groupBy("_slot").agg(F.min(F.struct("_depth", "_prefix")).alias("_b"))
    # buckets in key order: the prefix filled up with zeros
    return chosen.select("_slot", F.col("_b._depth").alias("_depth"), F.expr(f"shiftleft(_b._prefix, {deepest} - _b._depth)").alias("_bucket")), deepest


def _owned(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows with the bucket that the directory names for their key; it is sent to all tasks, having 2**MOST_DEPTH slots of 20 bytes at most."""
    return rows.withColumn("_slot", _slot(F.col("_key"), depth)).join(F.broadcast(slots), "_slot").drop("_slot")


def exact_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index entries, and the documents' keys with the bucket that the directory names for each.

    Entries (_bucket, _depth, _key, _sha, _chain, _keep, _size), one for each different text; keys (_id, _bucket, _key, _sha).
    """
    spark = docs.sparkSession
    rows = texts(docs).select("_id", normalised(F.col("_text")).alias("_norm"))
    hashed = rows.select("_id", F.xxhash64("_norm").alias("_key"), "_norm")
    slots, depth = directory(hashed.select("_key").distinct(), capacity)
    slots = written(slots, "directory")
    # the owner of a bucket compares bytes: equal ones are one entry, with the smallest id and the number of rows
    entries = _owned(hashed, slots, depth).groupBy("_bucket", "_depth", "_key", "_norm").agg(F.min("_id").alias("_keep"), F.count("*").alias("_size"))
    entries = entries.select("_bucket", "_depth", "_key", F.sha2("_norm", 256).alias("_sha"), "_keep", "_size")
    chained = entries.withColumn("_chain", F.row_number().over(Window.partitionBy("_bucket", "_key").orderBy("_keep", "_sha")) - 1)
    path = new_path(spark, "index")
    owned = chained.select("_bucket", "_depth", "_key", "_sha", "_chain", "_keep", "_size").repartitionByRange("_bucket").sortWithinPartitions("_bucket", "_key", "_chain")
    owned.write.parquet(path)
    index = spark.read.schema(owned.schema).parquet(path)
    keys = _owned(hashed.select("_id", "_key", F.sha2("_norm", 256).alias("_sha")), slots, depth)
    return index, keys.select("_id", "_bucket", "_key", "_sha")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs`` (doc_id, text).

    Texts are equal when they are identical after each run of ASCII white space is replaced by one space; of equal texts the row
    with the smallest doc_id stays. Null counts as the empty text. A null doc_id comes before all others; rows that repeat both id
    and text are all counted, and all kept if theirs is the smallest id. Other columns are ignored; an empty table gives an
    empty table.
    """
    index, keys = exact_index(docs, capacity)
    # a document is looked up in its bucket, along its key's chain
    found = keys.join(index.select("_bucket", "_key", "_sha", "_keep", "_size"), ["_bucket", "_key", "_sha"])
    return found.select(id_or_none("_id").alias("doc_id"), id_or_none("_keep").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_id") == F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))
