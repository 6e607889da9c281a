"""Reading tracks from CSV files with the header time,lat,lon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.operators.tracks import time_from_text, with_row_ids

#: What stands for a missing value.
NULLS = ("", "null")


def _value(name: str) -> Column:
    return F.when(~F.lower(F.trim(name)).isin(*NULLS), F.trim(name))


def read_tracks(spark: SparkSession, path: str, coerce: bool = True, only: str | None = "*.csv") -> DataFrame:
    """track_id (the file's name up to its first dot), time_ns, lat, lon of one file, a folder's .csv files or a glob;
    with ``only`` another pattern of names, or None, all of a folder's files.

    Empty fields, blanks and null in any case are missing. A time that is none is missing, too, or with coerce unset
    an error. Times are text with up to nine decimals or whole nanoseconds. A file with other columns is an error.
    """
    raw = spark.read.option("header", True).options(**({"pathGlobFilter": only} if only else {})).schema("time string, lat string, lon string").option("enforceSchema", False).csv(path)
    text = _value("time")
    time_ns = F.when(text.rlike("^-?[0-9]+$"), text.try_cast("long")).otherwise(time_from_text(text))
    if not coerce:
        time_ns = F.when(text.isNotNull() & time_ns.isNull(), F.raise_error(F.concat(F.lit("not a time: "), text)).cast("long")).otherwise(time_ns)
    return raw.select(
        F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("track_id"), time_ns.alias("time_ns"),
        _value("lat").try_cast("double").alias("lat"), _value("lon").try_cast("double").alias("lon"),
    )


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """read_tracks with row ids in order of time, rows with missing values gone."""
    return with_row_ids(read_tracks(spark, path), ("lat", "lon"))
