"""The given tables seen as movements, flight-plan style clocks and user events.

``moves`` reads orders as movements: a completion clock, a start clock and schedules derived from the
order's own values, two phases and a share of rows without a plan. ``ticks`` reads the event table. The
CTEs below say the same in SQL for the result checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.clock import DAY, SECOND, epoch_us
from eventloom.sources.readers import read_table


def moves(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: id, entity, lane, slot, phase, clocks (µs) and the outcome in seconds."""
    o = read_table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    o = o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 10).alias("entity"),
        F.substring("o_orderpriority", 1, 1).alias("lane"),
        (F.col("o_custkey") % 97).alias("slot"),
        (F.col("o_custkey") % 30).alias("carrier"),
        (F.col("o_orderkey") % 6).alias("kind"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("IN")).otherwise(F.lit("OUT")).alias("phase"),
        (F.col("o_orderstatus") != "P").alias("matched"),
        cents.alias("cents"),
        (epoch_us("o_orderdate") + (F.col("o_orderkey") * 7919 % 86400) * SECOND).alias("moved_us"),
    )
    outcome = 600 + F.col("cents") % 172800
    started = F.when(F.col("matched"), F.col("moved_us") - outcome * SECOND)
    return o.select(
        *o.columns,
        started.alias("start_us"),
        (F.col("moved_us") - (F.col("cents") % 200003 - 20000) * SECOND).alias("planned_us"),
        (started - (F.col("cents") % 7207 - 3600) * SECOND).alias("filed_us"),
        (started - (F.col("cents") % 5003 - 2000) * SECOND).alias("lodged_us"),
        outcome.cast("double").alias("y"),
    )


def outs(spark: SparkSession, folder: str) -> DataFrame:
    return moves(spark, folder).where("phase = 'OUT'")


def ins(spark: SparkSession, folder: str) -> DataFrame:
    return moves(spark, folder).where("phase = 'IN'")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user event: id, entity (ten groups), user, kind, time (µs) and value in cents."""
    e = read_table(spark, folder, "events", ["event_id", "ts", "user_id", "event_type", "value"])
    return e.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).alias("entity"),
        F.col("user_id"),
        F.col("event_type").alias("kind"),
        epoch_us("ts").alias("at_us"),
        F.round(F.col("value") * 100).cast("long").cast("double").alias("v"),
    )


CTES = {
    "MOVES": f"""moves0 AS (
  SELECT o_orderkey AS id, o_custkey % 10 AS entity, substr(o_orderpriority, 1, 1) AS lane, o_custkey % 97 AS slot,
    o_custkey % 30 AS carrier, o_orderkey % 6 AS kind,
    CASE WHEN o_orderkey % 3 = 0 THEN 'IN' ELSE 'OUT' END AS phase, o_orderstatus <> 'P' AS matched,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    epoch_us(o_orderdate) + (o_orderkey * 7919 % 86400) * {SECOND} AS moved_us
  FROM orders),
moves1 AS (
  SELECT *, 600 + cents % 172800 AS outcome,
    CASE WHEN matched THEN moved_us - (600 + cents % 172800) * {SECOND} END AS start_us FROM moves0),
moves AS (
  SELECT id, entity, lane, slot, carrier, kind, phase, matched, cents, moved_us, start_us,
    moved_us - (cents % 200003 - 20000) * {SECOND} AS planned_us,
    start_us - (cents % 7207 - 3600) * {SECOND} AS filed_us,
    start_us - (cents % 5003 - 2000) * {SECOND} AS lodged_us,
    CAST(outcome AS DOUBLE) AS y
  FROM moves1),
outs AS (SELECT * FROM moves WHERE phase = 'OUT'),
ins AS (SELECT * FROM moves WHERE phase = 'IN')""",
    "TICKS": """ticks AS (
  SELECT event_id AS id, user_id % 10 AS entity, user_id, event_type AS kind, epoch_us(ts) AS at_us,
    CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS v
  FROM events)""",
    "DAY": str(DAY),
    "HOUR": str(DAY // 24),
    "SECOND": str(SECOND),
}
