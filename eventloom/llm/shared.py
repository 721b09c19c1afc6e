"""What the operators share: tables written to the cluster's shared folder, ids, and session settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import tune
from eventloom.sources.scratch import new_path, shared_folder, written  # noqa: F401

#: Stands for a null id inside an operator; it comes before every other id.
NO_ID = -(1 << 63)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings: those of the library, and Arrow batches that bound a task's memory with long texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def id_or_none(c: str | Column) -> Column:
    """An inner id back as a document's id."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != NO_ID, c)


def texts(docs: DataFrame) -> DataFrame:
    """(_id, _text) of every row: null ids as NO_ID, null texts empty; other columns play no part."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("_text"))
