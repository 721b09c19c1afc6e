"""Station weather reports: reading, decoding and joining as of a row's time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.clock import MINUTE, epoch_us
from eventloom.operators.asof import asof, keep_last
from eventloom.sources.readers import read_csv_tolerant

# Columns, time format, weather codes and limits of the reports.
REPORT_FIELDS = {
    "station": "string", "valid": "timestamp", "tmpf": "double", "dwpf": "double", "relh": "double", "drct": "double",
    "sknt": "double", "p01i": "double", "vsby": "double", "gust": "double", "wxcodes": "string",
}
REPORT_TIME = "yyyy-MM-dd HH:mm"
FOG_CODE, WET_CODES = "FG", "RA|SN|DZ|SH|TS|GR|PL|IC"
LOW_VISIBILITY, FOG_VISIBILITY, STRONG_WIND, STALE_MINUTES = 1.0, 0.5, 20.0, 180
MEASURES = ["vsby", "sknt", "gust", "tmpf", "relh", "p01i"]
FLAGS = ["low_visibility", "fog", "wet", "strong_wind"]


def read_reports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reports of several overlapping files; of equal (station, time) the last one read is kept."""
    raw = read_csv_tolerant(spark, paths, REPORT_FIELDS, time_formats={"valid": REPORT_TIME}, required=("station", "valid"))
    kept = raw.where(F.col("valid").isNotNull() & F.col("station").isNotNull())
    return keep_last(kept, ["station", "valid"], F.struct("_place", "_file", "_block", "_line")).drop("_place", "_file", "_block", "_line")


def decode(reports: DataFrame) -> DataFrame:
    """Flags for low visibility, fog, precipitation and strong wind."""
    code = F.upper(F.coalesce("wxcodes", F.lit("")))
    less = lambda c, x: F.coalesce(F.col(c) < x, F.lit(False))
    return reports.withColumns({
        "low_visibility": less("vsby", LOW_VISIBILITY).cast("int"),
        "fog": (code.contains(FOG_CODE) | less("vsby", FOG_VISIBILITY)).cast("int"),
        "wet": (code.rlike(WET_CODES) | F.coalesce(F.col("p01i") > 0, F.lit(False))).cast("int"),
        "strong_wind": F.coalesce(F.col("sknt") >= STRONG_WIND, F.lit(False)).cast("int"),
    })


def attach(df: DataFrame, reports: DataFrame, entity: str, at_us: str) -> DataFrame:
    """The last report of the row's station; nothing of it is used when it is older than three hours."""
    right = reports.withColumn("_valid_us", epoch_us("valid"))
    take = {c: c for c in MEASURES + FLAGS} | {"_report_us": "_valid_us"}
    got = asof(df, right, [entity], at_us, "_valid_us", take, right_keys=["station"], within_us=(0, STALE_MINUTES * MINUTE))
    flags = {c: F.coalesce(F.col(c), F.lit(0)) for c in FLAGS}
    return got.withColumns(flags | {"report_missing": F.col("_report_us").isNull().cast("int")}).drop("_report_us")
