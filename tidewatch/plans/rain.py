"""Rain by town over events, gauges named after towns, guides of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import norm_key
from tidewatch.operators import rainfall, trend
from tidewatch.plans.registry import observations, query, table
from tidewatch.plans.water import _impacts, _levels, latest_classed

TOWNS = """, rr AS (SELECT 'town ' || station % 40 AS location_key, 'Town ' || station % 40 AS name, date_trunc('hour', ts) AS ts, CASE WHEN station % 6 <> 0 THEN height END AS rain, seq FROM obs),
lo AS (SELECT DISTINCT 'town ' || station % 40 AS location_key, 'Catchment ' || station % 8 AS catchment FROM obs WHERE station % 40 < 30),
lr AS (SELECT rr.*, catchment FROM rr JOIN (SELECT location_key, max(ts) AS ts FROM rr GROUP BY 1) m USING (location_key, ts) LEFT JOIN lo USING (location_key)) """


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("station")
    town = (s % 40).cast("string")
    return observations(spark, sf_dir).select(F.concat(F.lit("town "), town).alias("location_key"), F.concat(F.lit("Town "), town).alias("name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.when(s % 6 != 0, F.col("height")).otherwise(float("nan")).alias("rain"), "seq")


def _locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("station")
    return observations(spark, sf_dir).where(s % 40 < 30).select(F.concat(F.lit("town "), (s % 40).cast("string")).alias("location_key"), F.concat(F.lit("Catchment "), (s % 8).cast("string")).alias("catchment")).distinct()


@query(TOWNS + "SELECT location_key, name, ts, rain, seq, catchment FROM lr")
def rain_by_town(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest rain of each town, all rows of its last hour."""
    return rainfall.latest_rainfall(_readings(spark, sf_dir), _locations(spark, sf_dir)).select("location_key", "name", "ts", "rain", "seq", "catchment")


@query(TOWNS + "SELECT count(*) AS locations, arg_min(name, (-rain, location_key)) FILTER (rain IS NOT NULL) AS wettest, max(rain) AS most FROM lr")
def rain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rainfall.summary(rainfall.latest_rainfall(_readings(spark, sf_dir), _locations(spark, sf_dir)))


@query(TOWNS + "SELECT DISTINCT station, location_key, lo.catchment FROM obs JOIN lo ON location_key = 'town ' || station % 40 WHERE station % 3 <> 0")
def gauge_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monitored town of each gauge, by the town in its name."""
    s = F.col("station")
    name = F.when(s % 3 == 0, "Creek").otherwise(F.concat(F.lit("Creek "), F.when(s % 3 == 1, " at ").otherwise("downstream of "), F.lit("Town "), (s % 40).cast("string"), F.lit(" (Weir) HG")))
    gauges = observations(spark, sf_dir).select("station").distinct().withColumn("station_name", F.regexp_replace(name, "  +", " "))
    gauges = gauges.withColumn("station_name", F.regexp_replace("station_name", " \\(Weir\\) HG$", " HG"))
    return rainfall.location_of_gauge(gauges, _locations(spark, sf_dir)).select("station", "location_key", "catchment")


@query(""", im AS (SELECT p_partkey % 150 AS station, p_size * 6.0 AS height_m, p_type AS town, p_brand || '.pdf' AS source_pdf FROM part) SELECT station, town, source_pdf, max(height_m) AS highest, count(*) AS impacts FROM im GROUP BY ALL""")
def station_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("station"), (F.col("p_size") * 6.0).alias("height_m"), F.col("p_type").alias("town"), F.concat("p_brand", F.lit(".pdf")).alias("source_pdf"))
    return rainfall.guides_of(rows, ["station"])


@query(""", im AS (SELECT p_partkey % 150 AS station, p_size * 6.0 AS height_m, p_name || ' ' || p_type AS impact FROM part), h AS (SELECT station, count(*) AS readings, min(height) AS lowest, max(height) AS highest FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY station)
SELECT c.station, lower(trim(' Gauge ' || c.station || ' ')) AS key, c.height, c.priority, coalesce(readings, 0) AS readings, lowest, highest, count(height_m) AS impacts, count(*) FILTER (c.height >= height_m) AS reached, max(height_m) FILTER (c.height >= height_m) AS last_reached FROM classed c LEFT JOIN h USING (station) LEFT JOIN im USING (station) GROUP BY ALL""")
def station_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's figures for every gauge: the latest height and class, the week's range, and how many impacts the water has reached."""
    from tidewatch.functions.times import at
    from tidewatch.plans.registry import as_of

    latest = latest_classed(spark, sf_dir).select("station", "height", "priority")
    week = observations(spark, sf_dir).where(F.col("ts").between(at("2024-01-13 00:00:00"), as_of())).groupBy("station").agg(F.count("*").alias("readings"), F.min("height").alias("lowest"), F.max("height").alias("highest"))
    table_ = trend.impact_table(_impacts(spark, sf_dir), latest.withColumnRenamed("height", "current"), _levels(spark, sf_dir))
    reached = table_.groupBy("station").agg(F.count("height_m").alias("impacts"), F.count_if("reached").alias("reached"), F.max(F.when(F.col("reached"), F.col("height_m"))).alias("last_reached"))
    out = latest.join(week, "station", "left").join(reached, "station", "left").fillna(0, ["readings", "impacts", "reached"])
    return out.withColumn("key", norm_key(F.concat(F.lit(" Gauge "), F.col("station").cast("string"), F.lit(" "))))
