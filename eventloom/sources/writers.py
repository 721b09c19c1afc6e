"""Sinks and the template contract."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.profile import forbid_columns


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv_table(df: DataFrame, path: str) -> None:
    """A result table as CSV, a file for each partition of its own, so that no task gathers it."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_result(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines, a file for each partition."""
    df.write.mode("overwrite").json(path)


def publish(df: DataFrame, path: str, refuse: tuple[str, ...] = (), **options: str) -> bool:
    """Write a table in two phases: into a folder beside ``path`` that nobody reads, then renamed as a whole.

    Until the rename there is nothing at ``path``, so a job that fails leaves no rows; once there, a retry changes nothing and
    returns False. ``refuse`` names parts of column names that must not be published.
    """
    forbid_columns(df, list(refuse))
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    if files.exists(target):
        return False
    stage = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    staged = jvm.org.apache.hadoop.fs.Path(stage)
    try:
        df.write.options(**options).parquet(stage)
        # of two writers one renames; the other finds the table there
        done = not files.exists(target) and files.rename(staged, target)
    finally:
        if files.exists(staged):
            files.delete(staged, True)
    return bool(done)


def splice(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """Replace values by key where the patch has one; every base row stays."""
    new = patch.select(F.col(key), F.col(value).alias("_new"))
    return base.join(new, [key], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def fill_template(template: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """The template's rows with predicted values; rows without a prediction keep null."""
    return template.select(key).join(predictions.select(key, value), [key], "left")


def template_report(template: DataFrame, predictions: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Violation counters of a prediction table against its template, one row.

    Both sides are reduced to counts per key in one grouping, so each is read once.
    """
    a = template.select(key, F.lit(1).alias("_t"), F.lit(0).alias("_p"), F.lit(None).cast("double").alias("_v"))
    b = predictions.select(key, F.lit(0).alias("_t"), F.lit(1).alias("_p"), F.col(value).cast("double").alias("_v"))
    g = a.unionByName(b).groupBy(key).agg(F.sum("_t").alias("t"), F.sum("_p").alias("p"), F.sum(F.when(F.col("_p") == 1, F.col("_v").isNull().cast("int"))).alias("nulls"), F.sum((~F.col("_v").between(low, high)).cast("int")).alias("outside"))
    return g.agg(
        F.sum("t").alias("template_rows"), F.sum("p").alias("predicted_rows"), F.count_if(F.col("p") > 1).alias("duplicate_ids"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_values"), F.coalesce(F.sum("outside"), F.lit(0)).alias("out_of_range"),
        F.count_if((F.col("t") > 0) & (F.col("p") == 0)).alias("missing_ids"), F.count_if((F.col("t") == 0) & (F.col("p") > 0)).alias("extra_ids"),
    )
