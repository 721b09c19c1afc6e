"""Days listed per entity, such as public holidays, and the flag they give a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_days(df: DataFrame, days: DataFrame, entity: str, day: Column, name: str) -> DataFrame:
    """True where (entity, day) is a row of ``days``; every row stays once."""
    listed = days.select(F.col("entity").alias(entity), F.col("day").alias("_day")).distinct().withColumn("_listed", F.lit(True))
    got = df.withColumn("_day", day).join(listed, [entity, "_day"], "left")
    return got.withColumn(name, F.coalesce("_listed", F.lit(False))).select(*df.columns, name)
