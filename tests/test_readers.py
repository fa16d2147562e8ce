"""Readers on small files as vendors export them, and sinks read back."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import readers


def _plain(df):
    return sorted(tuple(r) for r in df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).collect())


def test_semicolon_files_with_empty_and_bad_values(spark, tmp_path):
    (tmp_path / "m.csv").write_text("NAME;DATE;LATITUDE;LONGITUDE;SPEED\nA;01/31/2024 23:59;5.5;-162.25;0.75\nB;02/01/2024 00:00;;x;\n")
    assert _plain(readers.read_vendor_m(spark, str(tmp_path))) == [("A", "2024-01-31 23:59:00", 5.5, -162.25, 0.75), ("B", "2024-02-01 00:00:00", None, None, None)]


def _export(tmp_path):
    wide, narrow = tmp_path / "wide.csv", tmp_path / "narrow.csv"
    head = "BuoyName{0}Timestamp{0}Latitude{0}Longitude{0}Speed\n"
    wide.write_bytes((head.format(";") + ";UTC;deg;deg;kn\nW1;2024-03-01 10:20;6.5;-161.5;1.5\n").encode("utf-16"))
    narrow.write_text(head.format(",") + ",UTC,deg,deg,kn\nN1,03/02/24 11:30,7.25,-160.75,0.5\n")
    return wide, narrow, ("W1", "2024-03-01 10:20:00", 6.5, -161.5, 1.5), ("N1", "2024-03-02 11:30:00", 7.25, -160.75, 0.5)


def test_both_forms_of_one_export(spark, tmp_path):
    wide, narrow, first, second = _export(tmp_path)
    assert _plain(readers.read_vendor_s(spark, str(wide))) == [first]
    assert _plain(readers.read_vendor_s_comma(spark, str(narrow))) == [second]
    assert _plain(readers.read_vendor_s_any(spark, str(tmp_path))) == sorted([first, second])
    assert _plain(readers.read_vendor_s_any(spark, str(wide))) == [first]


def test_dump_cuts_times_to_the_minute(spark, tmp_path):
    (tmp_path / "d.csv").write_text("Name;StoredTime;Latitude;Longitude;Speed\nD;2024/04/05 06:07:59;5;-162;2\n")
    assert _plain(readers.read_dump(spark, str(tmp_path))) == [("D", "2024-04-05 06:07:00", 5.0, -162.0, 2.0)]


def test_drifters_have_no_speed_and_repeats_go_once(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CommID,DateTime,Latitude,Longitude\n300,2024-01-01 01:00:00,5.125,-163.5\n300,2024-01-01 01:00:00,5.125,-163.5\n301,,6,-160\n")
    rows = readers.read_drifters(spark, str(tmp_path))
    one, two = ("300", "2024-01-01 01:00:00", 5.125, -163.5, None), ("301", None, 6.0, -160.0, None)
    assert rows.count() == 3 and _plain(rows.where("buoy_id = '300'")) == [one, one]
    both = readers.union_vendors(rows, rows.withColumn("extra", F.lit(None).cast("string")).drop("speed"))
    assert both.count() == 2 and sorted(r["buoy_id"] for r in both.collect()) == [one[0], two[0]]


def test_tracks_fields_and_results_read_back(spark, tmp_path):
    t = dt.datetime
    fixes = spark.createDataFrame([("a", t(2024, 1, 31, 23), 5.0, -162.0), ("a", t(2024, 2, 1, 1), 5.5, -162.5)], "buoy_id string, ts timestamp, lat double, lon double")
    readers.write_tracks(fixes, f"{tmp_path}/tracks")
    back = readers.read_tracks(spark, f"{tmp_path}/tracks")
    assert _plain(back.select(*fixes.columns)) == _plain(fixes) and back.where("month = '2024-02'").count() == 1
    fields = spark.createDataFrame([("wind", 1.0), ("wave", 2.0)], "product string, u double")
    fields.write.parquet(f"{tmp_path}/field")
    assert readers.read_field(spark, f"{tmp_path}/field").count() == 2
    assert [r["u"] for r in readers.read_field(spark, f"{tmp_path}/field", "wave").collect()] == [2.0]
    for kind in ("csv", "parquet"):
        readers.write_result(fields, f"{tmp_path}/{kind}", kind)
        got = spark.read.option("header", True).csv(f"{tmp_path}/csv") if kind == "csv" else spark.read.parquet(f"{tmp_path}/parquet")
        assert sorted((r["product"], float(r["u"])) for r in got.collect()) == [("wave", 2.0), ("wind", 1.0)]


def test_forecast_files_become_one_table(spark, tmp_path):
    head = "model,buoy_id,ts,lat_true,lon_true,lat_fc,lon_fc,lead_h\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text(head + "m,a,2024-01-01 00:00:00,5,-162,5.5,-162.5,4\n")
    (tmp_path / "in" / "2.csv").write_text(head + "n,b,2024-01-01 06:00:00,6,-161,6.5,-161.5,8\n")
    out = readers.combine_forecasts(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert sorted((r["model"], r["lat_fc"], r["lead_h"]) for r in out.collect()) == [("m", 5.5, 4.0), ("n", 6.5, 8.0)]


def test_portal_files_name_the_buoy(spark, tmp_path):
    (tmp_path / "buoy7_positions_3.csv").write_text("StoredTime;Latitude;Longitude\n2024-05-01 12:00:00;6º30.000'N;161º45.000'W\n2024-05-01 12:00:00;6º30.000'N;161º45.000'W\n2024-05-01 13:00:00;;\n")
    got = _plain(readers.read_live(spark, str(tmp_path)))
    assert got == [("buoy7", "2024-05-01 12:00:00", 6.5, -161.75), ("buoy7", "2024-05-01 13:00:00", None, None)]
