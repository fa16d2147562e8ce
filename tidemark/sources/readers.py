"""Readers of vendors' position files, and sinks. Every reader gives (buoy, ts, lat, lon, ...) with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import degrees_minutes

RAW = ["buoy_id", "ts", "lat", "lon", "speed"]


def _raw(df: DataFrame, name: str, ts: Column, lat: str, lon: str, speed: str | None) -> DataFrame:
    value = F.col(speed).try_cast("double") if speed else F.lit(None).cast("double")
    return df.select(F.col(name).alias("buoy_id"), ts.alias("ts"), F.col(lat).try_cast("double").alias("lat"), F.col(lon).try_cast("double").alias("lon"), value.alias("speed"))


def read_vendor_m(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Semicolon files NAME;DATE;LATITUDE;LONGITUDE;SPEED (A1)."""
    df = spark.read.schema("NAME string, DATE string, LATITUDE string, LONGITUDE string, SPEED string").options(sep=";", header=True, enforceSchema=False).csv(path)
    return _raw(df, "NAME", F.try_to_timestamp("DATE", F.lit("MM/dd/yyyy HH:mm")), "LATITUDE", "LONGITUDE", "SPEED")


def read_vendor_s(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """UTF-16 semicolon files with a row of units, which has no time and goes by that (A2)."""
    df = spark.read.schema("BuoyName string, Timestamp string, Latitude string, Longitude string, Speed string").options(sep=";", header=True, encoding="UTF-16", multiLine=True).csv(path)
    out = _raw(df, "BuoyName", F.try_to_timestamp("Timestamp", F.lit("yyyy-MM-dd HH:mm")), "Latitude", "Longitude", "Speed")
    return out.where("ts is not null")


def read_vendor_s_comma(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The comma form of the same export (A3)."""
    df = spark.read.schema("BuoyName string, Timestamp string, Latitude string, Longitude string, Speed string").options(sep=",", header=True).csv(path)
    out = _raw(df, "BuoyName", F.try_to_timestamp("Timestamp", F.lit("MM/dd/yy HH:mm")), "Latitude", "Longitude", "Speed")
    return out.where("ts is not null")


def read_vendor_s_any(spark: SparkSession, path: str) -> DataFrame:
    """Files of either form, told apart by the byte-order mark of UTF-16 (A3). Only file names reach the driver."""
    mark = F.hex(F.substring("content", 1, 2))
    files = spark.read.format("binaryFile").load(path).select("path", mark.isin("FFFE", "FEFF").alias("wide")).collect()
    wide, narrow = ([f["path"] for f in files if f["wide"] == w] for w in (True, False))
    if wide and narrow:
        return read_vendor_s(spark, wide).unionByName(read_vendor_s_comma(spark, narrow))
    return read_vendor_s(spark, wide) if wide else read_vendor_s_comma(spark, narrow)


def read_dump(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Exports Name;StoredTime;..., times cut to the minute (A4)."""
    df = spark.read.schema("Name string, StoredTime string, Latitude string, Longitude string, Speed string").options(sep=";", header=True).csv(path)
    return _raw(df, "Name", F.date_trunc("minute", F.try_to_timestamp("StoredTime", F.lit("yyyy/MM/dd HH:mm:ss"))), "Latitude", "Longitude", "Speed")


def read_drifters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Comma files CommID,DateTime,Latitude,Longitude (A5)."""
    df = spark.read.schema("CommID string, DateTime string, Latitude string, Longitude string").options(header=True).csv(path)
    return _raw(df, "CommID", F.col("DateTime").try_cast("timestamp"), "Latitude", "Longitude", None)


def union_vendors(*tables: DataFrame) -> DataFrame:
    """All vendors' rows, exact repeats once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.dropDuplicates()


def read_live(spark: SparkSession, path: str) -> DataFrame:
    """Portal exports with positions as degrees and minutes; the buoy is the file's name up to _positions."""
    df = spark.read.schema("StoredTime string, Latitude string, Longitude string").options(header=True, sep=";").csv(path)
    buoy = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)_positions", 1)
    time = F.col("StoredTime").try_cast("timestamp_ntz").cast("timestamp")
    return df.select(buoy.alias("buoy_id"), time.alias("ts"), degrees_minutes(F.col("Latitude")).alias("lat"), degrees_minutes(F.col("Longitude")).alias("lon")).dropDuplicates()


def write_tracks(fixes: DataFrame, path: str) -> None:
    """The long track table as Parquet by month, so that time filters skip files."""
    fixes.withColumn("month", F.date_format("ts", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A track table that write_tracks() wrote."""
    return spark.read.parquet(path)


def read_field(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """A field as long Parquet, of one product if asked."""
    df = spark.read.parquet(path)
    return df.where(F.col("product") == product) if product else df


def combine_forecasts(spark: SparkSession, path: str, to: str) -> DataFrame:
    """All forecast files of a folder as one Parquet table (A10)."""
    schema = "model string, buoy_id string, ts timestamp, lat_true double, lon_true double, lat_fc double, lon_fc double, lead_h double"
    spark.read.schema(schema).options(header=True).csv(path).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A result table as Parquet or CSV."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
