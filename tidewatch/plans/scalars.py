"""Texts, times and hashes, over parts, documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import classify, hashes, text, times
from tidewatch.functions.geo import geohash_centre
from tidewatch.plans.registry import query, table
from tidewatch.sources import feeds


@query("""SELECT p_partkey AS id, split_part('Creek at ' || p_name || ' HG', ' at ', 2)[:-4] AS town, split_part(p_type || ', ' || p_brand, ', ', 1) AS "primary", p_brand AS sub, 'Flood Warning' AS pretty, lower(p_name) AS key, CASE WHEN length(p_name) > 8 THEN rtrim(left(p_name, 7)) || '…' ELSE p_name END AS short FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = text.split_type(F.concat("p_type", F.lit(", "), F.col("p_brand")))
    gauge = F.concat(F.lit("Creek at "), F.col("p_name"), F.lit(" HG"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.gauge_town(gauge).alias("town"), kind["primary"].alias("primary"), kind["sub"].alias("sub"), text.pretty(F.lit("flood_warning")).alias("pretty"), text.norm_key(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("\n "))).alias("key"), text.shorten(F.col("p_name"), 8).alias("short"))


@query("""SELECT o_orderkey AS id, CAST(o_orderkey % 90 AS DOUBLE) AS value, '02:40pm' AS "time", CAST(o_orderkey % 5000 AS DOUBLE) + 0.25 AS hectares FROM orders""")
def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = text.value_time(F.concat((k % 90).cast("string"), F.lit("02:40pm")))
    return table(spark, sf_dir, "orders").select(k.alias("id"), v["value"].alias("value"), v["time"].alias("time"), text.hectares(F.concat(F.lit("about "), F.format_number((k % 5000) + 0.25, 2), F.lit(" Ha."))).alias("hectares"))


@query("""SELECT event_id AS id, date_trunc('second', ts) + INTERVAL 11 HOUR AS local, CAST(floor(value * 60) AS BIGINT) AS minutes,
CASE WHEN floor(value * 60) < 1 THEN 'just now' WHEN floor(value * 60) < 90 THEN CAST(floor(value * 60) AS BIGINT) || ' min ago' WHEN floor(value * 60) % 60 > 0 THEN CAST(floor(value) AS BIGINT) || ' hr ' || CAST(floor(value * 60) AS BIGINT) % 60 || ' min ago' ELSE CAST(floor(value) AS BIGINT) || ' hr ago' END AS age FROM events""".replace("CAST(floor(value) AS BIGINT)", "CAST(floor(value * 60) AS BIGINT) // 60"))
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC stamps as local times (summer time in January), and ages in words."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    minutes = F.floor(F.col("value") * 60)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), times.iso_to_local(stamp).alias("local"), minutes.alias("minutes"), times.describe_age(minutes.cast("double")).alias("age"))


@query("""SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, left(sha256('10.0.0.' || user_id || '|agent|' || strftime(ts, '%Y-%m-%d') || '|salt'), 16) AS visitor FROM events""")
def visitor_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashes.visitor_hash(F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")), F.lit("agent"), F.date_format("ts", "yyyy-MM-dd"), "salt")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k long")["k"].alias("k"), h.alias("visitor"))


@query("""SELECT event_id AS id, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][1 + CAST(floor((event_id % 360) / 45 + 0.5) AS BIGINT) % 8] AS point, CASE WHEN value < 60 THEN '0-60' WHEN value < 180 THEN '60-180' WHEN value < 360 THEN '180-360' ELSE '360+' END AS lead FROM events""")
def compass_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), classify.cardinal(F.col("event_id") % 360).alias("point"), classify.lead_bucket(F.col("value")).alias("lead"))


@query("""SELECT id, CASE WHEN good THEN 90 * list_sum(list_transform(range(2, length(bits) + 1, 2), lambda i: (2 * CAST(bits[i] AS INTEGER) - 1) / pow(2, i // 2))) END AS latitude, CASE WHEN good THEN 180 * list_sum(list_transform(range(1, length(bits) + 1, 2), lambda i: (2 * CAST(bits[i] AS INTEGER) - 1) / pow(2, (i + 1) // 2))) END AS longitude
FROM (SELECT s_suppkey AS id, regexp_matches(code, '^[0-9bcdefghjkmnpqrstuvwxyz]+$') AS good, array_to_string(list_transform(range(1, length(code) + 1), lambda i: lpad(bin(greatest(0, instr('0123456789bcdefghjkmnpqrstuvwxyz', code[i]) - 1)), 5, '0')), '') AS bits FROM (SELECT s_suppkey, 'r1' || replace(lower(to_base(s_suppkey, 32)), 'a', 'z') AS code FROM supplier))""")
def geohash_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("r1"), F.replace(F.lower(F.conv(F.col("s_suppkey").cast("string"), 10, 32)), F.lit("a"), F.lit("z")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), geohash_centre(code).alias("centre")).select("id", "centre.latitude", "centre.longitude")


@query()
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables and lists in pages, with their cells."""
    return feeds.html_rows(table(spark, sf_dir, "pages"), "page_id", "html")
