"""Reading: guarded multi-file parquet, tolerant CSV, drifting schemas."""

from __future__ import annotations

import csv
import os
import re
from fnmatch import fnmatch
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark files a training reader must refuse.
REFUSED_WORDS = ("ranking", "submitting", "submission", "test", "eval")


def read_table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """One parquet table, with the schema its footer has now."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, paths: list[str], columns: list[str]) -> DataFrame:
    """One scan over many parquet files, only the named columns."""
    return spark.read.parquet(*paths).select(*columns)


def check_allowed(paths: list[str], prefix: str, refused: tuple[str, ...] = REFUSED_WORDS) -> list[str]:
    """Raise before any scan unless every file name starts with ``prefix`` and holds no refused word."""
    for path in paths:
        name = os.path.basename(path.rstrip("/")).lower()
        stem = name.rsplit(".", 1)[0]
        if not name.startswith(prefix):
            raise PermissionError(f"{path}: only files named {prefix}* may be read here")
        if any(word in stem for word in refused):
            raise PermissionError(f"{path}: this file is kept out of training")
    return paths


def read_guarded(spark: SparkSession, paths: list[str], columns: list[str], prefix: str) -> DataFrame:
    return read_many(spark, check_allowed(paths, prefix), columns)


def read_csv_tolerant(
    spark: SparkSession,
    paths: list[str],
    fields: dict[str, str],
    comment: str = "#",
    null_values: tuple[str, ...] = ("M", ""),
    time_formats: dict[str, str] | None = None,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """CSV files read by header name; missing columns become typed nulls and bad cells become null.

    One scan finds the header of every file (its first line that is neither blank nor a comment), and files of one layout are read
    together, so the plan grows with the layouts and not with the files. ``_place`` is a path's place in ``paths``, ``_file`` the file,
    ``_block`` where the file's split starts, and ``_line`` grows with the lines of a split: in this order they are the order of
    reading. ``_bad`` counts a row's cells that hold something else than their type.
    """
    formats = time_formats or {}
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    lines = lines.where((F.trim("value") != "") & ~F.startswith(F.col("value"), F.lit(comment)))
    headers = lines.groupBy("_file").agg(F.min_by("value", F.struct("_block", "_line")).alias("header")).collect()  # a row for each file
    layouts: dict[str, list[str]] = {}
    for r in headers:
        lost = [c for c in required if c.lower() not in _names(r["header"])]
        if lost:
            raise ValueError(f"{r['_file']}: header lacks {lost}")
        layouts.setdefault(r["header"], []).append(r["_file"])
    parts = []
    for header, files in sorted(layouts.items()):
        have = {n: f"c{i}" for i, n in reversed(list(enumerate(_names(header))))}
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(_names(header)))])
        raw = spark.read.schema(schema).option("header", True).option("comment", comment).option("mode", "PERMISSIVE").csv([unquote(f) for f in files])
        place = F.create_map(*[F.lit(x) for f in files for x in (f, _place(f, paths))])
        raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()}).withColumn("_place", place[F.col("_file")])
        cells, bad = [], [F.lit(0)]
        for name, kind in fields.items():
            source = have.get(name.lower())
            if source is None:
                cells.append(F.lit(None).cast(kind).alias(name))
                continue
            text = F.trim(F.col(source))
            text = F.when(text.isin(*null_values), None).otherwise(text)
            cell = _typed(text, kind, formats.get(name))
            cells.append(cell.alias(name))
            bad.append((text.isNotNull() & cell.isNull()).cast("int"))
        parts.append(raw.select(*cells, "_place", "_file", "_block", "_line", reduce(lambda a, b: a + b, bad).alias("_bad")))
    if not parts:
        empty = [T.StructField(n, T._parse_datatype_string(k)) for n, k in fields.items()]
        kinds = (("_place", "int"), ("_file", "string"), ("_block", "bigint"), ("_line", "bigint"), ("_bad", "int"))
        return spark.createDataFrame([], T.StructType(empty + [T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _names(header: str) -> list[str]:
    """Column names of a header line, in lower case."""
    return [c.strip().lower() for c in next(csv.reader([header]))]


def _place(file: str, paths: list[str]) -> int:
    """Which of the paths a file was found by: itself, its folder, or a pattern."""
    plain = lambda p: re.sub(r"^[a-z0-9]+:/+", "/", p).rstrip("/")
    name = plain(unquote(file))
    return next((i for i, p in enumerate(paths) if name == plain(p) or name.startswith(plain(p) + "/") or fnmatch(name, plain(p) + "*")), len(paths))


def _typed(text: Column, kind: str, time_format: str | None) -> Column:
    if kind == "timestamp":
        return F.try_to_timestamp(text, F.lit(time_format)) if time_format else F.try_to_timestamp(text)
    return text if kind == "string" else text.try_cast(kind)


def read_drifting(spark: SparkSession, paths: list[str], columns: dict[str, str]) -> DataFrame:
    """Parquet files whose columns may be strings in some files and timestamps in others."""
    parts = []
    for path in paths:
        df = spark.read.parquet(path)
        kinds = {f.name: f.dataType for f in df.schema.fields}
        cells = []
        for name, kind in columns.items():
            if name not in kinds:
                cells.append(F.lit(None).cast(kind).alias(name))
            elif kind == "timestamp" and isinstance(kinds[name], T.StringType):
                cells.append(F.try_to_timestamp(F.col(name)).alias(name))
            else:
                cells.append(F.col(name).cast(kind).alias(name))
        parts.append(df.select(*cells))
    return reduce(lambda a, b: a.unionByName(b), parts)


def split_by_phase(df: DataFrame, phase: str, out_value: str, origin: str, destination: str, entity: str) -> tuple[DataFrame, DataFrame]:
    """The outgoing and incoming stream of one table, each with the entity it belongs to."""
    is_out = F.col(phase) == F.lit(out_value)
    named = df.withColumn(entity, F.when(is_out, F.col(origin)).otherwise(F.col(destination)))
    return named.where(is_out), named.where(~is_out)


def join_filled(df: DataFrame, table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Left join of numeric attributes; missing ones take the attribute's mean over the table."""
    means = table.agg(*[F.avg(c).alias(c) for c in columns])
    joined = df.join(table.select(*keys, *columns), keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), means.select(c).scalar()) for c in columns})
