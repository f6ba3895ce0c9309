"""Entries with their surroundings: readings as changes, suppliers as roads, customers as outages, parts as fires."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import context
from tidewatch.plans.registry import as_of, coords, instants, observations, place, query, table
from tidewatch.plans.water import latest_classed

KM = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
XY = "-39 + ({0} % 50) * CAST(0.1 AS DOUBLE) AS lat, 141 + ({0} % 80) * CAST(0.1 AS DOUBLE) AS lon"
HAZARD = "CASE catchment WHEN 'error' THEN 'flood' WHEN 'click' THEN 'fire' WHEN 'view' THEN 'power' ELSE 'roads' END"
LAYERS_SQL = f""", layers AS (SELECT 'roads' AS layer, {XY.format("s_suppkey")}, CAST(s_nationkey % 2 AS DOUBLE) AS amount, CAST(NULL AS BIGINT) AS grade, CAST(NULL AS VARCHAR) AS level FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'outages', {XY.format("(c_custkey // 3)")}, floor(c_acctbal), NULL, NULL FROM customer WHERE c_custkey % 4 = 0 AND (c_custkey // 3) % 5 <> 0
UNION ALL SELECT 'gauges', lat, lon, 0, NULL, NULL FROM classed JOIN coords USING (station) WHERE priority < 4
UNION ALL SELECT 'fires', {XY.format("p_partkey")}, CAST(p_size % 3 = 0 AS INT), CASE WHEN p_size % 3 = 0 THEN p_size % 9 // 3 + 1 END, CASE WHEN p_size % 3 = 0 THEN ['Emergency Warning', 'Watch and Act', 'Advice'][p_size % 9 // 3 + 1] END FROM part WHERE p_partkey % 10 = 1 AND p_size % 5 <> 0),
changes AS (SELECT seq AS event_id, ts, {HAZARD} AS hazard, CASE WHEN height >= major THEN 3 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 1 ELSE 0 END AS severity, 'Place ' || station % 30 || ' ' || {HAZARD} AS headline, CASE WHEN station % 3 <> 0 THEN 'Town ' || station % 30 END AS entity_name, station, height,
  CASE WHEN station % 5 <> 0 THEN -39 + (station % 50) * CAST(0.1 AS DOUBLE) END AS lat, CASE WHEN station % 5 <> 0 THEN 141 + (station % 80) * CAST(0.1 AS DOUBLE) END AS lon FROM obs),
""" + """fig(lat, lon, roads, closures, outages, customers, gauges, fires, warnings) AS (SELECT a.lat, a.lon, count(*) FILTER (layer = 'roads'), coalesce(sum(amount) FILTER (layer = 'roads'), 0), count(*) FILTER (layer = 'outages'), coalesce(sum(amount) FILTER (layer = 'outages'), 0), count(*) FILTER (layer = 'gauges'), count(*) FILTER (layer = 'fires'), coalesce(sum(amount) FILTER (layer = 'fires'), 0) FROM (SELECT DISTINCT lat, lon FROM changes WHERE lat IS NOT NULL) a JOIN layers b ON {KM} <= 30 GROUP BY a.lat, a.lon),
grades AS (SELECT a.lat, a.lon, arg_min(level, (grade, level)) AS level FROM (SELECT DISTINCT lat, lon FROM changes WHERE lat IS NOT NULL) a JOIN layers b ON {KM} <= 30 WHERE grade IS NOT NULL GROUP BY a.lat, a.lon),
said AS (SELECT f.*, g.level, [CASE WHEN roads > 0 THEN roads || ' road disruption' || CASE WHEN roads = 1 THEN '' ELSE 's' END || CASE WHEN closures > 0 THEN ' (' || CAST(closures AS BIGINT) || ' full closure' || CASE WHEN closures > 1 THEN 's' ELSE '' END || ')' ELSE '' END || ' within 30 km' END,
  CASE WHEN outages > 0 THEN outages || ' power outage' || CASE WHEN outages = 1 THEN '' ELSE 's' END || ' nearby — ' || format('{:,}', CAST(customers AS BIGINT)) || ' customers off' END] AS firsts,
  CASE WHEN gauges > 0 THEN gauges || ' gauge' || CASE WHEN gauges = 1 THEN '' ELSE 's' END || ' at or above minor flood level within 30 km' END AS wet, CASE WHEN fires > 0 THEN fires || ' active incident' || CASE WHEN fires = 1 THEN '' ELSE 's' END || CASE WHEN warnings > 0 THEN ', ' || CAST(warnings AS BIGINT) || ' under warning' ELSE '' END || ' within 30 km' END AS hot FROM fig f LEFT JOIN grades g ON g.lat = f.lat AND g.lon = f.lon)
""".replace("{KM}", KM)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("catchment")
    hazard = F.when(c == "error", "flood").when(c == "click", "fire").when(c == "view", "power").otherwise("roads")
    s, h = F.col("station"), F.col("height")
    lat, lon = place(s)
    severity = F.when(h >= F.col("major"), 3).when(h >= F.col("moderate"), 2).when(h >= F.col("minor"), 1).otherwise(0)
    town = (s % 30).cast("string")
    return observations(spark, sf_dir).select(
        F.col("seq").alias("event_id"), "seq", "ts", hazard.alias("hazard"), severity.alias("severity"), F.concat(F.lit("Place "), town, F.lit(" "), hazard).alias("headline"), F.when(s % 3 != 0, F.concat(F.lit("Town "), town)).alias("entity_name"),
        "height", F.when(s % 5 != 0, lat).alias("lat"), F.when(s % 5 != 0, lon).alias("lon"),
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    roads = table(spark, sf_dir, "supplier").select(*place(k), (F.col("s_nationkey") % 2).alias("is_closure"), (k % 7 == 0).cast("int").alias("resolved"))
    town = F.expr("c_custkey div 3")
    cust = table(spark, sf_dir, "customer").select(town.alias("location"), F.floor("c_acctbal").alias("customers_off"), (F.col("c_custkey") % 4 != 0).cast("int").alias("restored"))
    lat, lon = place(F.col("location"))
    cache = cust.select("location").distinct().select("location", F.when(F.col("location") % 5 != 0, lat).alias("lat"), F.when(F.col("location") % 5 != 0, lon).alias("lon"))
    gauges = latest_classed(spark, sf_dir).join(coords(spark, sf_dir), "station")
    size = F.col("p_size")
    levels = F.array(F.lit("Emergency Warning"), F.lit("Watch and Act"), F.lit("Advice"))
    fires = table(spark, sf_dir, "part").where("p_partkey % 10 = 1").select(*place(F.col("p_partkey")), F.when(size % 5 == 0, "burn-area").when(size % 3 == 0, "warning").otherwise("incident").alias("feed_type"), F.element_at(levels, (F.floor(size % 9 / 3) + 1).cast("int")).alias("warning_level"), F.lit(0).alias("resolved"))
    return context.standing(roads, context.placed(cust, cache), gauges, fires)


@query(LAYERS_SQL + """SELECT c.event_id, coalesce(roads, 0) AS roads, CAST(coalesce(closures, 0) AS BIGINT) AS closures, coalesce(outages, 0) AS outages, CAST(coalesce(customers, 0) AS BIGINT) AS customers, coalesce(gauges, 0) AS gauges, coalesce(fires, 0) AS fires, CAST(coalesce(warnings, 0) AS BIGINT) AS warnings, level FROM changes c LEFT JOIN said s ON s.lat = c.lat AND s.lon = c.lon""")
def surroundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands within 30 km of every entry."""
    rows = context.surroundings(changes(spark, sf_dir).select("event_id", "lat", "lon"), layers(spark, sf_dir), 30.0)
    return rows.select("event_id", "roads", "closures", "outages", "customers", "gauges", "fires", "warnings", "level")


@query(LAYERS_SQL + """, newest AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS position FROM changes WHERE ts BETWEEN TIMESTAMP '2024-01-12 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND severity >= 1 AND hazard IN ('flood', 'fire', 'power') QUALIFY position < 120)
SELECT CAST(position AS INTEGER) AS position, event_id AS id, array_to_string(list_filter(list_concat([coalesce(entity_name || ': ', '') || format('{:.2f}', height) || ' m'], CASE WHEN position < 40 THEN list_concat(list_concat([CASE WHEN hazard = 'fire' THEN level || ' remains current' END], firsts), [CASE WHEN hazard <> 'flood' THEN wet END, CASE WHEN hazard <> 'fire' THEN hot END]) ELSE [] END), lambda x: x IS NOT NULL), '; ') AS lines
FROM newest n LEFT JOIN said s ON s.lat = n.lat AND s.lon = n.lon""")
def feed_with_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries of three hazards, the first forty with what stands around them."""
    null = {"prev_value": "double", "prev_label": "string", "new_label": "string", "since": "timestamp_ntz", "rate": "string"}
    rows = changes(spark, sf_dir).withColumnsRenamed({"event_id": "id", "height": "new_value"}).withColumns({"metric": F.lit("height_m"), "unit": F.lit("m")} | {c: F.lit(None).cast(t) for c, t in null.items()})
    out = context.feed(rows, layers(spark, sf_dir), as_of() - F.expr("INTERVAL 8 DAYS"), as_of(), hazards=["flood", "fire", "power"], least=1, km=30.0)
    return out.select("position", "id", F.array_join("lines", "; ").alias("lines"))


@query(LAYERS_SQL + f""", pos AS (SELECT hazard, headline, arg_max(lat, (ts, event_id)) AS lat, arg_max(lon, (ts, event_id)) AS lon FROM changes WHERE lat IS NOT NULL GROUP BY hazard, headline),
w AS (SELECT c.event_id, c.hazard, c.headline, c.entity_name, p.lat, p.lon, row_number() OVER (ORDER BY severity DESC, ts DESC, event_id) AS k FROM changes c JOIN pos p USING (hazard, headline) WHERE severity >= 2 AND ts BETWEEN TIMESTAMP '2024-01-19 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'),
walk(k, anchors, joined) AS (SELECT 0, CAST([] AS STRUCT(k BIGINT, lat DOUBLE, lon DOUBLE)[]), CAST(NULL AS BIGINT)
  UNION ALL SELECT CAST(b.k AS INTEGER), CASE WHEN len(list_filter(anchors, lambda a: {KM} <= 30)) = 0 THEN list_append(anchors, {{'k': b.k, 'lat': b.lat, 'lon': b.lon}}) ELSE anchors END, coalesce(list_filter(anchors, lambda a: {KM} <= 30)[1].k, b.k) FROM walk JOIN w b ON b.k = walk.k + 1),
m AS (SELECT w.*, joined FROM w JOIN walk USING (k)),
top AS (SELECT joined, row_number() OVER (ORDER BY joined) - 1 AS position FROM m GROUP BY joined HAVING count(DISTINCT hazard) >= 2 QUALIFY position < 6),
hl AS (SELECT joined, headline, min(k) AS k FROM m GROUP BY ALL), said_by AS (SELECT joined, list(headline ORDER BY k) AS h FROM hl GROUP BY joined)
SELECT CAST(position AS INTEGER) AS position, coalesce(m.entity_name, m.headline) AS title, m.hazard, array_to_string(list_filter(list_concat(list_concat(h, firsts), [wet, hot]), lambda x: x IS NOT NULL), '; ') AS lines
FROM top JOIN m ON m.k = top.joined JOIN said_by b ON b.joined = top.joined LEFT JOIN said s ON s.lat = m.lat AND s.lon = m.lon""", recursive=True)
def emerging_consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest six places where several hazards meet, with what was said and what stands around."""
    all_ = changes(spark, sf_dir)
    window = all_.where(F.col("ts").between(as_of() - F.expr("INTERVAL 24 HOURS"), as_of())).drop("lat", "lon", "seq", "height")
    out = context.consequences(window, all_, layers(spark, sf_dir), km=30.0)
    return out.select("position", "title", "hazard", F.array_join("lines", "; ").alias("lines"))


RAIN_TIMES = ["2024-01-08 06:00:00", "2024-01-12 12:00:00", "2024-01-16 18:00:00", "2024-01-20 00:00:00"]


@query(f""", t(moment) AS (VALUES {", ".join(f"(TIMESTAMP '{t}')" for t in RAIN_TIMES)}),
near AS (SELECT a.station, b.station AS wmo, {KM} AS km FROM coords a JOIN coords b ON {KM} <= 50),
steps AS (SELECT station AS wmo, moment, ts, seq, height, lag(height) OVER (PARTITION BY station, moment ORDER BY ts, seq) AS q FROM obs JOIN t ON ts <= moment AND ts >= moment - INTERVAL 72 HOUR WHERE height IS NOT NULL),
tot AS (SELECT wmo, moment, sum(CASE WHEN q IS NULL THEN 0 WHEN height >= q THEN height - q ELSE height END) AS total FROM steps GROUP BY ALL HAVING count(*) >= 2)
SELECT station, moment, round(max(total), 4) AS max_mm, arg_min(wmo, (-round(total, 6), round(km, 6), wmo)) AS wettest, count(*) AS stations FROM near JOIN tot USING (wmo) GROUP BY station, moment""")
def rain_near_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rain of three days at the wettest station within 50 km of each gauge, at four times."""
    places = coords(spark, sf_dir)
    readings = observations(spark, sf_dir).select(F.col("station").alias("wmo"), "ts", "seq", F.col("height").alias("rain"))
    out = context.catchment_rainfall(places, instants(spark, RAIN_TIMES), places.withColumnRenamed("station", "wmo"), readings, hours=72)
    return out.select("station", F.col("at").alias("moment"), F.round("max_mm", 4).alias("max_mm"), "wettest", "stations")
