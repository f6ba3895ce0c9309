"""Words, names, classes and clock times, over parts, orders, events and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import classify, geo, hashes, text, times
from tidewatch.operators import changes, temporal
from tidewatch.plans.registry import as_of, observations, query, table
from tidewatch.sources import feeds


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN abs(r) < 0.01 THEN 'Steady' ELSE CASE WHEN r > 0 THEN 'Rising' ELSE 'Falling' END || printf(' %.2f m/hr', abs(r)) END AS rate,
CASE WHEN h >= 0.25 AND o_orderkey % 17 <> 0 THEN printf('+%.0f ha/hr', o_custkey % 50 * 2 / h) END AS growth, CASE WHEN w = 0 OR d = 'calm' THEN 'Calm' WHEN trim(d) = '' THEN printf('%.0f km/h', CAST(w AS DOUBLE)) ELSE concat_ws(' ', d, printf('%.0f km/h', CAST(w AS DOUBLE))) END AS wind,
CASE WHEN o_orderkey % 11 = 0 THEN '—' ELSE printf('%.1f mm', CAST(o_orderkey % 1000 / 10 AS DOUBLE)) END AS rain, CASE WHEN o_orderkey % 11 = 0 THEN '—' ELSE printf('%.0f%%', CAST(o_orderkey % 101 AS DOUBLE)) END AS humidity, (o_custkey % 3) || CASE WHEN o_custkey % 3 = 1 THEN ' crew' ELSE ' crews' END AS crews
FROM (SELECT *, (o_orderkey % 401 - 200) / 100 AS r, [0, 0.25, 0.5, 1][1 + o_orderkey % 4] AS h, o_orderkey % 60 AS w, ['N', ' ', 'calm', NULL, 'SSW'][1 + o_orderkey % 5] AS d FROM orders)""")
def readings_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates, growth, wind, rain and humidity as people read them."""
    k = F.col("o_orderkey")
    before = F.when(k % 17 != 0, F.col("o_custkey") % 97)
    hours = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)]), (k % 4 + 1).cast("int"))
    direction = F.element_at(F.array(F.lit("N"), F.lit(" "), F.lit("calm"), F.lit(None).cast("string"), F.lit("SSW")), (k % 5 + 1).cast("int"))
    known = lambda c: F.when(k % 11 != 0, c)
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), text.rate_text(F.when(k % 13 != 0, (k % 401 - 200) / 100)).alias("rate"), text.growth_text(before, before + F.col("o_custkey") % 50 * 2, hours).alias("growth"), text.wind_text(direction, k % 60).alias("wind"),
        text.measured(known(k % 1000 / 10), 1, "mm").alias("rain"), text.measured(known(k % 101), 0, "%").alias("humidity"), text.plural(F.col("o_custkey") % 3, "crew").alias("crews"),
    )


@query("""SELECT p_partkey AS id, p_name || ', ' || p_type AS flat, regexp_replace(trim(p_name || ' / ' || p_type || '.x'), '[^A-Za-z0-9_-]+', '_', 'g') AS file, 'export' AS nothing, p_name || ' ' || lower(p_brand[1:5]) AS town,
'&lt;' || p_name || ' &amp; ' || p_brand || '&gt;' AS xml, replace(p_name, ' ', '%20') || '/' || replace(p_brand, '#', '%23') AS quoted, p_name || '/' || p_brand AS unquoted, [p_name, p_type] AS lines, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part""")
def names_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as lists, file names, towns, XML and paths."""
    name, brand = F.col("p_name"), F.col("p_brand")
    path = F.concat(name, F.lit("/"), brand)
    guide = F.concat(F.lit("guides/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit("_"), F.lower(F.left(brand, F.lit(5))), F.lit(" - Local Flood Guide.pdf"))
    listed = F.to_json(F.array(name, F.lit(" "), F.col("p_type")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.flat_list(F.array(name, F.lit(" "), F.lit(None).cast("string"), F.col("p_type"))).alias("flat"), text.safe_name(F.concat(F.lit(" "), name, F.lit(" / "), "p_type", F.lit(".x "))).alias("file"), text.safe_name(F.lit(" ")).alias("nothing"),
        text.town_of_file(guide).alias("town"), text.xml_escape(F.concat(F.lit("<"), name, F.lit(" & "), brand, F.lit(">"))).alias("xml"), text.quote_path(path).alias("quoted"), text.unquote_path(text.quote_path(path)).alias("unquoted"),
        hashes.json_lines(listed).alias("lines"), hashes.no_nan(F.when(F.col("p_partkey") % 5 == 0, float("nan")).otherwise(F.col("p_retailprice"))).alias("price"),
    )


@query("""SELECT id, CASE WHEN met THEN 'Met' WHEN l IN ('Emergency Warning', 'EVACUATE') THEN 'Emergency Warning' WHEN l = ' watch and act' THEN 'Watch and Act' ELSE 'Advice' END AS kind, met,
coalesce(CASE l WHEN 'Emergency Warning' THEN 1 WHEN 'EVACUATE' THEN 1 WHEN ' watch and act' THEN 2 WHEN 'Advice' THEN 3 END, CASE WHEN contains(lower(c), 'fire') THEN 4 ELSE 5 END) AS fire, CASE o_orderpriority[1] WHEN '1' THEN 1 WHEN '2' THEN 2 WHEN '3' THEN 3 ELSE 4 END AS "group",
CASE WHEN hi >= 12 OR (hi >= 10 AND mean >= 8) THEN 'strong' WHEN hi >= 8 THEN 'moderate' ELSE 'weak' END AS storm, round(4 * mean + 2.5 * hi + least(o_custkey / 15, 20), 6) AS score, CASE WHEN hi <> 0 THEN round(100 * (mean - hi) / hi, 6) END AS pct, round(least(20, greatest(4, sqrt(o_custkey) * 0.5)), 6) AS marker
FROM (SELECT o_orderkey AS id, *, ['Emergency Warning', 'EVACUATE', ' watch and act', 'Advice', 'nonsense', NULL][1 + o_orderkey % 6] AS l, ['Bushfire', 'MET', 'Tree down', NULL][1 + o_orderkey % 4] AS c, coalesce(['Bushfire', 'MET', 'Tree down', NULL][1 + o_orderkey % 4] = 'MET', false) AS met, o_orderkey % 16 AS hi, o_custkey % 12 AS mean FROM orders)""")
def classes_of_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings, weather groups and storm cells by class, and sizes that depend on figures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (k % n + 1).cast("int"))
    level, kind = pick(6, "Emergency Warning", "EVACUATE", " watch and act", "Advice", "nonsense", None), pick(4, "Bushfire", "MET", "Tree down", None)
    group = F.element_at(F.array(*[F.lit(x) for x in ("Severe", "moderate", "minor", "other", "none")]), F.left("o_orderpriority", F.lit(1)).cast("int"))
    high, mean = k % 16, c % 12
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), classify.map_kind(level, kind, F.lit(None).cast("string")).alias("kind"), classify.is_met(F.lit(None).cast("string"), kind).alias("met"), classify.fire_priority(level, kind).alias("fire"), classify.group_priority(group).alias("group"),
        classify.storm_class(high, mean).alias("storm"), F.round(classify.intensity(mean, high, c), 6).alias("score"), F.round(classify.percent_change(high, mean), 6).alias("pct"), F.round(classify.marker_size(c, 0.5, 4.0, 20.0), 6).alias("marker"),
    )


@query("""SELECT event_id AS id, CASE WHEN m = date_trunc('day', m) THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-01-19 00:00:00' + (m - date_trunc('day', m)) END AS clock, CASE WHEN m > TIMESTAMP '2024-01-20 00:00:00' THEN m - INTERVAL 1 YEAR ELSE m END AS dated, TIMESTAMP '2024-01-20 00:00:00' AS neither,
date_trunc('day', ts) AS first, date_trunc('day', ts) + INTERVAL 86399 SECOND AS last, m AS joined, date_trunc('day', ts) AS day_only, CAST(floor(epoch_us(date_trunc('second', ts) - TIMESTAMP '2024-01-01 00:00:00') / 6e7 + 0.5) AS DOUBLE) AS minutes FROM (SELECT *, date_trunc('minute', ts) AS m FROM events)""")
def clock_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of feeds and forms: clocks without a day, days without a year, tags' bounds."""
    form = lambda f: F.date_format("ts", f)
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), times.clock_time(form("HH:mm"), as_of()).alias("clock"), times.clock_time(form("H:mm d/M"), as_of()).alias("dated"), times.clock_time(F.lit("soon"), as_of()).alias("neither"),
        times.tag_bound(form("yyyy-MM-dd"), False).alias("first"), times.tag_bound(form("yyyy-MM-dd"), True).alias("last"), times.join_date_time(form("yyyy-MM-dd"), form("HH:mm")).alias("joined"), times.join_date_time(form("yyyy-MM-dd"), F.lit(" ")).alias("day_only"),
        times.outage_minutes(times.at("2024-01-01 00:00:00"), second).cast("double").alias("minutes"),
    )


@query("""SELECT s_suppkey AS id, round((degrees(atan2(s_suppkey % 7 - 3, -(s_suppkey % 5 - 2))) + 360) % 360, 6) AS bearing, 1 + CAST(s_suppkey % 3 <> 0 AS INT) AS polygons, 3 AS corners, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS INT) AS lines FROM supplier""")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearings of velocities; polygons and lines of GeoJSON."""
    k = F.col("s_suppkey")
    ring = F.concat(F.lit("[[["), k.cast("string"), F.lit(",-37.5],[145,-37],[146,-37.5]]]"))
    polygon = lambda r: F.concat(F.lit('{"type":"Polygon","coordinates":'), r, F.lit("}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}"))
    mixed = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), polygon(ring), F.lit(',{"type":"Point","coordinates":[1,2]},'), polygon(ring), F.lit("]}"))
    polygons = geo.geojson_polygons(F.when(k % 3 == 0, polygon(ring)).when(k % 3 == 1, many).otherwise(mixed))
    line = "[[1,2],[3,4]]"
    lines = geo.geojson_lines(F.when(k % 2 == 0, F.lit(f'{{"type":"LineString","coordinates":{line}}}')).otherwise(F.lit(f'{{"type":"MultiLineString","coordinates":[{line},{line}]}}')))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.round(F.pmod(geo.bearing(k % 7 - 3, k % 5 - 2), F.lit(360.0)), 6).alias("bearing"), F.size(polygons).alias("polygons"), F.size(polygons[0][0]).alias("corners"), F.size(lines).alias("lines"))


@query("""SELECT station, ts, seq, height, NULL AS note FROM (SELECT station, date_trunc('day', ts) AS ts, seq, height, max(date_trunc('day', ts)) OVER (PARTITION BY station) AS m FROM obs) WHERE ts = m UNION ALL SELECT station, ts, seq, NULL, 'latest' FROM latest""")
def latest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings of each gauge's last day, and below them its latest one as a row of other columns."""
    rows = observations(spark, sf_dir).select("station", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), "seq", "height")
    last = temporal.latest(observations(spark, sf_dir).where(F.col("ts") <= as_of()), ["station"], ["ts", "seq"]).select("station", "ts", "seq", F.lit("latest").alias("note"))
    return changes.append_union(temporal.latest_with_ties(rows, ["station"], "ts"), last)


@query("SELECT date_trunc('second', ts) + INTERVAL 11 HOUR AS \"timestamp\", CAST(event_id % 5000 AS INTEGER) AS customers_off, CAST(CASE WHEN event_id % 7 <> 0 THEN event_id % 100 END AS INTEGER) AS planned, CAST(user_id AS INTEGER) AS unplanned FROM events")
def power_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older table of outage totals: UTC stamps and counts with commas."""
    number = F.format_number(F.col("event_id") % 5000, 0)
    stamp = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    planned = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 100).cast("string")).otherwise("none")
    return feeds.power_series(table(spark, sf_dir, "events").select(stamp.alias("timestamp"), number.alias("customers_off"), planned.alias("planned"), F.col("user_id").cast("string").alias("unplanned")))
