"""Queries that write tables and read them back through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans.registry import query
from eventloom.plans.tables import moves
from eventloom.sources import readers, writers
from eventloom.sources.scratch import new_path

FIELDS = {"id": "bigint", "entity": "bigint", "y": "double", "moved": "timestamp"}


@query(
    "s04_tolerant_csv",
    """WITH $MOVES
SELECT id, CASE WHEN id % 3 <> 1 THEN entity END AS entity, CASE WHEN id % 7 > 1 THEN y END AS y, CASE WHEN id % 3 <> 2 THEN moved_us END AS moved_us,
  CAST(id % 7 = 1 AS INT) AS bad FROM moves""",
)
def s04(spark, folder):
    """CSV files of three layouts with marks for missing values and cells of another type, read in one pass of each layout."""
    m = moves(spark, folder)
    y = F.when(F.col("id") % 7 == 0, "M").when(F.col("id") % 7 == 1, "?").otherwise(F.col("y").cast("string"))
    m = m.select("id", "entity", y.alias("y"), F.date_format(F.timestamp_micros("moved_us"), "yyyy-MM-dd HH:mm:ss").alias("Moved"))
    paths = []
    for part, columns in enumerate((["id", "entity", "y", "Moved"], ["Moved", "y", "id"], ["y", "entity", "id"])):
        paths.append(new_path(spark, f"layout{part}"))
        m.where(F.col("id") % 3 == part).select(*columns).write.option("header", True).csv(paths[-1])
    got = readers.read_csv_tolerant(spark, paths, FIELDS, time_formats={"moved": "yyyy-MM-dd HH:mm:ss"}, required=("id", "y"))
    return got.select("id", "entity", "y", F.unix_micros("moved").alias("moved_us"), F.col("_bad").alias("bad"))


@query(
    "s08_s09_s10_sinks",
    """WITH $MOVES, f AS (SELECT unnest(['csv', 'json', 'published', 'partitioned']) AS sink)
SELECT f.sink, m.entity, count(*) AS n, CAST(sum(m.cents) AS BIGINT) AS cents, count(m.start_us) AS started FROM f, moves m GROUP BY f.sink, m.entity""",
)
def s08(spark, folder):
    """The sinks, each written and read back; the published table is written twice and stays as it was."""
    m = moves(spark, folder).select("id", "entity", "cents", "start_us")
    at = {sink: new_path(spark, sink) for sink in ("csv", "json", "published", "partitioned")}
    writers.write_csv_table(m, at["csv"])
    writers.write_json_result(m, at["json"])
    writers.write_parquet(m, at["partitioned"], ["entity"])
    for table in (m, m.where("id % 2 = 0")):
        writers.publish(table, at["published"], refuse=("outcome",))
    kinds = "id bigint, entity bigint, cents bigint, start_us bigint"
    read = spark.read.schema(kinds)
    tables = {"csv": read.option("header", True).csv(at["csv"]), "json": read.json(at["json"]), "published": read.parquet(at["published"]), "partitioned": read.parquet(at["partitioned"])}
    parts = [t.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.count("start_us").alias("started")).select(F.lit(sink).alias("sink"), "entity", "n", "cents", "started") for sink, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
