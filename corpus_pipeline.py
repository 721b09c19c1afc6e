"""The corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import extendible_index, fm_toxicity, minmax_near, slack_packing, template_leaks
from eventloom.llm.queries import END_ID, table, tokenizer_path
from eventloom.llm.shared import new_path, prepare, written


#: Marks the column that holds a row's key, carried from the first stage on: decisions are taken by row, since ids may be null or repeat.
MARK = "corpus_pipeline_row"


def _row(docs: DataFrame) -> str | None:
    """The name of the key's column; one of the input's own that only looks like it is not marked."""
    return next((f.name for f in docs.schema.fields if f.metadata.get(MARK)), None)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their key; where there is none yet, rows are numbered and written, so that the numbers stay."""
    if _row(docs):
        return docs
    name = "_pipeline_row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return written(docs.withColumn(name, F.monotonically_increasing_id().alias(name, metadata={MARK: True})), "keyed")


def _by_row(docs: DataFrame) -> DataFrame:
    """What the operators read, with the row's key as its id."""
    return docs.select(F.col(_row(docs)).alias("doc_id"), "text")


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """Rows whose key is not among the doc_id of ``judged``."""
    return docs.join(judged.select(F.col("doc_id").alias("_gone")), F.col(_row(docs)) == F.col("_gone"), "left_anti")


def _without_copies(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of each group in ``groups`` (doc_id: a row's key, _group) stays: that of the smallest doc_id (null first), and of its rows the first."""
    members = groups.withColumnRenamed("doc_id", "_key").join(docs.select(F.col(_row(docs)).alias("_key"), F.col("doc_id").alias("_id")), "_key")
    kept = members.groupBy("_group").agg(F.min(F.struct("_id", "_key")).alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    return _without(docs, members.join(kept, "_group").where("_key != _kept._key").select(F.col("_key").alias("doc_id")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier calls toxic go; it learns from labels of documents given, outside the held-out fold."""
    prepare(spark)
    docs = _keyed(docs)
    machine = fm_toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return _without(docs, fm_toxicity.scored(_by_row(docs), machine).where("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one of the smallest doc_id stays."""
    prepare(spark)
    docs = _keyed(docs)
    judged = extendible_index.exact_duplicates(_by_row(docs)).where("group_size > 1")
    return _without_copies(docs, judged.select("doc_id", F.col("keep_id").alias("_group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row of the smallest doc_id stays."""
    prepare(spark)
    docs = _keyed(docs)
    judged = minmax_near.near_duplicates(_by_row(docs))
    return _without_copies(docs, judged.select("doc_id", F.col("component_id").alias("_group")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item, verbatim or re-parameterised, go."""
    prepare(spark)
    docs = _keyed(docs)
    return _without(docs, template_leaks.leaks(_by_row(docs), table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, placed in sequences."""
    prepare(spark)
    return slack_packing.pack(docs, tokenizer_path(), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", packed),
]

#: Classifier, near copies and tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
