import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.functions.holidays import flag_days
from eventloom.operators import asof as joins
from eventloom.operators import profile
from eventloom.sources import readers, weather, writers


def test_guarded_paths():
    assert readers.check_allowed(["/d/training_01.parquet"], "training_") == ["/d/training_01.parquet"]
    for bad in ("/d/ranking_01.parquet", "/d/training_test.parquet", "/d/other.parquet"):
        with pytest.raises(PermissionError):
            readers.check_allowed([bad], "training_")


def test_many_files_and_guard(spark, tmp_path):
    for m in (1, 2):
        spark.range(m * 10).withColumn("x", F.lit(m)).withColumn("unused", F.lit("z")).write.parquet(str(tmp_path / f"training_{m}.parquet"))
    got = readers.read_guarded(spark, [str(tmp_path / f"training_{m}.parquet") for m in (1, 2)], ["id", "x"], "training_")
    assert got.columns == ["id", "x"] and got.count() == 30


def test_weather_reports(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text("# downloaded\nstation,valid,tmpf,vsby,sknt,p01i,wxcodes\nAAAA,2025-01-01 00:20,33.5,0.4,5,0,\nAAAA,2025-01-01 00:50,M,9,25,bad,-RA\n")
    b.write_text("valid,station,vsby,wxcodes\n2025-01-01 00:50,AAAA,2.0,FG\nnot a time,AAAA,1,\n")
    raw = weather.read_reports(spark, [str(a), str(b)])
    rows = {r.valid: r for r in raw.collect()}
    assert len(rows) == 2
    late = rows[dt.datetime(2025, 1, 1, 0, 50)]
    assert late.vsby == 2.0 and late.tmpf is None  # the later file wins
    marked = {r.valid: r for r in weather.decode(raw).collect()}
    assert marked[dt.datetime(2025, 1, 1, 0, 20)].fog == 1 and marked[dt.datetime(2025, 1, 1, 0, 50)].fog == 1
    flights = spark.createDataFrame([(1, "AAAA", dt.datetime(2025, 1, 1, 1, 0)), (2, "AAAA", dt.datetime(2025, 1, 1, 9, 0)), (3, "BBBB", dt.datetime(2025, 1, 1, 1, 0))], "id long, entity string, at timestamp")
    got = {r.id: r for r in weather.attach(flights.withColumn("at_us", F.unix_micros("at")), weather.decode(raw), "entity", "at_us").collect()}
    assert (got[1].vsby, got[1].fog, got[1].report_missing) == (2.0, 1, 1 - 1)
    assert (got[2].vsby, got[2].fog, got[2].report_missing) == (None, 0, 1)  # older than three hours
    assert got[3].report_missing == 1


def test_csv_header_is_checked(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_csv_tolerant(spark, [str(p)], {"a": "int"}, required=("station",))


def test_geometry_input_and_mean_filling(spark, tmp_path):
    p = tmp_path / "lanes.csv"
    p.write_text("entity,lane,length_ft,heading\nAAAA,28,9000,280\nAAAA,10,,100\n")
    lanes = readers.read_csv_tolerant(spark, [str(p)], {"entity": "string", "lane": "string", "length_ft": "double", "heading": "double"})
    left = spark.createDataFrame([(1, "AAAA", "28"), (2, "AAAA", "10"), (3, "BBBB", "01")], "id long, entity string, lane string")
    got = {r.id: r.length_ft for r in readers.join_filled(left, lanes, ["entity", "lane"], ["length_ft", "heading"]).collect()}
    assert got == {1: 9000.0, 2: 9000.0, 3: 9000.0}


def test_drifting_schema(spark, tmp_path):
    spark.createDataFrame([("1", "2025-01-01 10:00:00")], "id string, seen string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("2", dt.datetime(2025, 1, 2))], "id string, seen timestamp").write.parquet(str(tmp_path / "b"))
    got = readers.read_drifting(spark, [str(tmp_path / "a"), str(tmp_path / "b")], {"id": "string", "seen": "timestamp", "extra": "double"})
    assert {r.id: r.seen.day for r in got.collect()} == {"1": 1, "2": 2}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "id long, p double")
    writers.write_parquet(df, str(tmp_path / "p"))
    writers.write_csv_table(df, str(tmp_path / "c"))
    writers.write_json_result(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["id", "p"]
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["id"] for x in lines} == {1, 2}


def test_template_contract(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    p = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, None), (9, 1e9)], "id long, v double")
    r = writers.template_report(t, p, "id", "v", 0.0, 100.0).first()
    assert (r.template_rows, r.predicted_rows, r.duplicate_ids, r.null_values, r.out_of_range, r.missing_ids, r.extra_ids) == (3, 4, 1, 1, 1, 1, 1)
    spliced = {x.id: x.v for x in writers.splice(p.where("id = 9"), spark.createDataFrame([(9, 7.0)], "id long, v double"), "id", "v").collect()}
    assert spliced == {9: 7.0}


def test_holidays(spark):
    days = spark.createDataFrame([("EGLL", dt.date(2025, 8, 25)), ("EGLL", dt.date(2025, 8, 25)), ("EDDF", dt.date(2025, 10, 3))], "entity string, day date")
    df = spark.createDataFrame([(1, "EGLL", dt.date(2025, 8, 25)), (2, "EDDF", dt.date(2025, 8, 25)), (3, "XXXX", None)], "id long, entity string, d date")
    assert {r.id: r.h for r in flag_days(df, days, "entity", F.col("d"), "h").collect()} == {1: True, 2: False, 3: False}


def test_schema_checks(spark):
    a, b = spark.createDataFrame([(1, "x")], "id long, s string"), spark.createDataFrame([(1, 2)], "id long, n int")
    assert profile.schema_differences({"a": a, "b": b}) == [("b", "n", "int", "missing"), ("b", "s", "missing", "string")]
    with pytest.raises(ValueError):
        profile.forbid_columns(a.withColumn("taxitime_x", F.lit(1)), ["TAXITIME"])
    assert joins.keep_last(a, ["id"], F.col("s")).count() == 1


def test_layouts_are_read_together_and_bad_cells_counted(spark, tmp_path):
    for i in range(12):
        head = "a,b" if i % 2 else "# first\nb , A"
        (tmp_path / f"f {i:02}.csv").write_text(f"{head}\n{i},{'x' if i == 3 else 7}\n")
    paths = [str(tmp_path / f"f {i:02}.csv") for i in range(12)]
    got = readers.read_csv_tolerant(spark, paths, {"a": "int", "b": "int", "c": "string"})
    rows = sorted((r._place, r.a, r.b, r.c, r._bad) for r in got.collect())
    assert rows == sorted((i, i if i % 2 else 7, (None if i == 3 else 7) if i % 2 else i, None, int(i == 3)) for i in range(12))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    folder = readers.read_csv_tolerant(spark, [str(tmp_path)], {"a": "int"})
    assert {r._place for r in folder.collect()} == {0} and folder.count() == 12
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert readers.read_csv_tolerant(spark, [str(tmp_path / "none")], {"a": "int"}).count() == 0


def test_published_tables_are_whole_or_not_there(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = spark.range(100).repartition(4).select(F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        writers.publish(broken, path)
    assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError):
        writers.publish(spark.range(3).withColumn("y_true", F.lit(1)), path, refuse=("Y_true",))
    assert writers.publish(spark.range(3), path) and not writers.publish(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_fits_refuse_columns(spark):
    from eventloom.operators import trees

    with pytest.raises(ValueError):
        trees.fit(spark.range(3).withColumn("y_true", F.lit(1.0)), ["y_true"], F.col("id"), ["all"], F.array(F.lit(0)), refuse=("y_",))
