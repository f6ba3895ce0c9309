"""Rain by town: latest readings, the town of a gauge, and the guides of a station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.operators.temporal import latest_with_ties


def latest_rainfall(readings: DataFrame, locations: DataFrame) -> DataFrame:
    """Rows of each location's last time, with its catchment, the most rain first and unknown rain last. readings: location_key, ts, rain and more."""
    rows = latest_with_ties(readings.where("location_key IS NOT NULL"), ["location_key"], "ts").withColumn("rain", text.to_double(F.col("rain")))
    return rows.join(locations.select("location_key", "catchment").dropDuplicates(["location_key"]), "location_key", "left").orderBy(F.desc_nulls_last("rain"), "location_key")


def summary(latest: DataFrame) -> DataFrame:
    """One row: the number of rows of `latest_rainfall`, and the name and rain of the first."""
    top = F.min_by(F.struct("name", "rain"), F.struct(F.col("rain").isNull(), (-F.col("rain")).alias("r"), "location_key"))
    return latest.agg(F.count("*").alias("locations"), top.alias("t")).select("locations", F.col("t.name").alias("wettest"), F.col("t.rain").alias("most"))


def location_of_gauge(gauges: DataFrame, locations: DataFrame) -> DataFrame:
    """gauges (station_name and more) with the location (its key and columns) of the town in their name; those without one are absent."""
    town = F.lower(text.gauge_town(F.col("station_name")))
    return gauges.withColumn("location_key", town).where("location_key IS NOT NULL").join(locations, "location_key")


def guides_of(impacts: DataFrame, keys: list[str]) -> DataFrame:
    """Each guide (town, source_pdf) of each station once, with its greatest height and its number of impacts."""
    return impacts.groupBy(*keys, "town", "source_pdf").agg(F.max("height_m").alias("highest"), F.count("*").alias("impacts"))
