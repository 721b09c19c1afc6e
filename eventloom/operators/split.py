"""Holdout splits: by period, by position in time, by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ranks import union_all
from eventloom.operators.slices import slice_width, time_slice, with_position


def by_period(df: DataFrame, period: str, held_out: list[int]) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a period column; rows without a period are in neither."""
    return df.where(~F.col(period).isin(held_out)), df.where(F.col(period).isin(held_out))


def time_position(df: DataFrame, at: str, tie: str, name: str = "position") -> DataFrame:
    """1-based position in one global order of (time, tie), computed per time slice."""
    cut = df.withColumn("_slice", time_slice(F.col(at), slice_width([(df, at)])))
    return with_position(cut, [], [at, tie], "_slice", name, spread_ties=True).drop("_slice")


def position_folds(df: DataFrame, at: str, tie: str, folds: int, name: str) -> DataFrame:
    return time_position(df, at, tie, "_pos").withColumn(name, ((F.col("_pos") - 1) % folds).cast("long")).drop("_pos")


def tail_split(df: DataFrame, at: str, tie: str, tail: float, name: str = "in_tail") -> DataFrame:
    """Mark the latest share of rows; the earlier part has ``floor(n * (1 - tail))`` rows exactly."""
    head = F.floor(df.agg(F.count(F.lit(1)).alias("n")).scalar() * F.lit(1.0 - tail))
    return time_position(df, at, tie, "_pos").withColumn(name, F.col("_pos") > head).drop("_pos")


def expanding_folds(df: DataFrame, period: str, folds: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """Rows of every fold with its name and role; a row occurs once per fold it takes part in."""
    parts = []
    for name, (train, predict) in folds.items():
        part = df.where(F.col(period).isin(train + predict))
        role = F.when(F.col(period).isin(predict), F.lit("predict")).otherwise(F.lit("train"))
        parts.append(part.withColumn("fold", F.lit(name)).withColumn("role", role))
    return union_all(parts)


def domain_shift(train: DataFrame, val: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: distinct values on each side, values new to validation, and the rows that carry them."""
    parts = []
    total = val.agg(F.count(F.lit(1)).alias("n")).scalar()
    for c in columns:
        seen = train.select(c).where(F.col(c).isNotNull()).distinct()
        here = val.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        marked = here.join(seen.withColumn("_seen", F.lit(1)), [c], "left")
        parts.append(
            marked.agg(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("values"),
                F.sum(F.when(F.col("_seen").isNull(), 1).otherwise(0)).alias("unseen_values"),
                (F.coalesce(F.sum(F.when(F.col("_seen").isNull(), F.col("_n"))), F.lit(0)) / F.max(total)).alias("unseen_row_share"),
            )
        )
    return union_all(parts)
