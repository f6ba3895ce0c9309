"""Alerts between two looks: gauges of events, and orders of two months as warnings, cells and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import at
from tidewatch.operators import alerts, temporal
from tidewatch.plans.registry import observations, query, table

#: The two looks: times of gauges, months of orders, and which look it is.
LOOKS = [("2024-01-16 00:00:00", "1996-12-01", "1997-01-01", 0), ("2024-01-18 00:00:00", "1996-12-16", "1997-01-16", 1)]

ALERTS_SQL = ", ents AS (SELECT * FROM (SELECT o.look, o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o.look, o_custkey ORDER BY o_orderkey DESC) AS j FROM orders JOIN (VALUES (0, DATE '1996-12-01', DATE '1997-01-01'), (1, DATE '1996-12-16', DATE '1997-01-16')) o(look, a, b) ON o_orderdate >= a AND o_orderdate < b) WHERE j = 1)" + """,
gl AS (SELECT * FROM (SELECT l.look, obs.*, row_number() OVER (PARTITION BY l.look, station ORDER BY ts DESC, seq DESC) AS j FROM obs JOIN (VALUES (0, TIMESTAMP '2024-01-16 00:00:00'), (1, TIMESTAMP '2024-01-18 00:00:00')) l(look, t) ON ts <= t) WHERE j = 1),
al AS (SELECT look, 'flood' AS kind, CAST(station AS VARCHAR) AS key, CASE WHEN height >= major THEN 1 WHEN height >= moderate THEN 2 ELSE 3 END AS priority, CASE WHEN height >= major THEN 'Major flooding' WHEN height >= moderate THEN 'Moderate flooding' ELSE 'Minor flooding' END AS label FROM gl WHERE height >= minor
UNION ALL SELECT look, 'fire', CAST(id AS VARCHAR), CASE WHEN id % 2 = 0 THEN 1 + (id + look) % 3 ELSE 4 END, CASE WHEN id % 2 = 0 THEN ['Emergency Warning', 'Watch and Act', 'Advice'][1 + (id + look) % 3] || ' — Town ' || id ELSE 'Bushfire at Town ' || id || ' (active)' END FROM ents WHERE id % 5 = 0 AND (id % 2 = 0 OR id % 3 = 0)
UNION ALL SELECT look, 'weather', CAST(id AS VARCHAR), 1 + (id + look) % 3, 'Flood Warning: Area ' || id FROM ents WHERE id % 5 = 1
UNION ALL SELECT look, 'storm', CAST(id AS VARCHAR), 1 + (id + look) % 3, CASE WHEN (id + look) % 3 = 0 THEN 'STRONG' ELSE 'MODERATE' END || ' cell ' || id || ' on radar (score ' || id % 100 || ', ~' || id || ' km²' || CASE WHEN id % 2 = 0 THEN ', S 40 km/h' ELSE '' END || ')' FROM ents WHERE id % 5 = 2 AND (id + look) % 3 < 2
UNION ALL SELECT look, 'roads', CAST(id AS VARCHAR), 1, 'Road ' || id || CASE WHEN id % 2 = 0 THEN ' (Town ' || id || ')' ELSE '' END || ' — Flooding' FROM ents WHERE id % 5 = 3),
ls(kind, most) AS (VALUES ('flood', 10), ('fire', 10), ('weather', 6), ('storm', 6), ('roads', 8))
"""


def looked_at(spark: SparkSession, sf_dir: str, look: int) -> DataFrame:
    """ALERT rows of all hazards at one of the looks."""
    when, start, end, k = LOOKS[look]
    latest = temporal.latest(observations(spark, sf_dir).where(F.col("ts") <= at(when)), ["station"], ["ts", "seq"])
    month = table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(at(start), at(end)) & (F.col("o_orderdate") < at(end)))
    ids = temporal.latest(month.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k")), ["id"], ["k"])
    i = F.col("id")
    town, step = F.concat(F.lit("Town "), i.cast("string")), (i + k) % 3
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (step + 1).cast("int"))
    warning = i % 2 == 0
    fires = ids.where("id % 5 = 0").select(i.alias("source_id"), F.when(warning, "warning").otherwise("incident").alias("feed_type"), F.when(i % 3 == 0, "Bushfire").otherwise("Tree Down").alias("category1"), F.when(warning, pick("Emergency Warning", "Watch and Act", "Advice")).alias("warning_level"), town.alias("location"), F.lit(None).cast("string").alias("status"))
    warnings = ids.where("id % 5 = 1").select(i.alias("warning_id"), pick("severe", "moderate", "minor").alias("group_type"), F.lit("flood_warning").alias("type"), F.concat(F.lit("Area "), i.cast("string")).alias("title"))
    cells = ids.where("id % 5 = 2").select(i.alias("cell_id"), F.lit(None).cast("string").alias("radar_id"), pick("strong", "moderate", "weak").alias("classification"), (i % 100).alias("intensity_score"), i.alias("area_km2"), F.lit(40).alias("speed_kmh"), F.when(warning, 180.0).alias("bearing_deg"))
    roads = ids.where("id % 5 = 3").select(i.alias("source_id"), F.concat(F.lit("Road "), i.cast("string")).alias("road_name"), F.when(warning, town).alias("location"), F.lit("Flooding").alias("disruption_type"), F.lit(1).alias("is_closure"))
    return alerts.all_alerts(alerts.flood(latest), alerts.fire(fires, [" bushfire"]), alerts.weather(warnings), alerts.storm(cells), alerts.roads(roads))


@query(ALERTS_SQL + """SELECT kind, 'started' AS part, count(*) AS n, 'worst: ' || arg_min(label, (priority, label)) AS text FROM al WHERE look = 0 AND kind IN ('flood', 'fire', 'weather') GROUP BY kind
UNION ALL SELECT kind, 'started', max(n), string_agg(label, '; ' ORDER BY k) FILTER (k <= 5) || CASE WHEN max(n) > 5 THEN ' (+' || max(n) - 5 || ' more)' ELSE '' END FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'storm' THEN label END, key) AS k FROM al WHERE look = 0 AND (kind = 'roads' OR kind = 'storm' AND priority = 1)) GROUP BY kind""")
def alerts_started(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds at a first look, by hazard, with the worst of it."""
    return alerts.started(looked_at(spark, sf_dir, 0))


@query(ALERTS_SQL + """, bo AS (SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.key, a.key) AS key, coalesce(a.priority, b.priority) AS priority, coalesce(a.label, b.label) AS label, CASE WHEN a.key IS NOT NULL AND (b.key IS NULL OR a.priority < b.priority) THEN 'escalated' WHEN a.key IS NULL AND (b.kind <> 'storm' OR b.priority = 1) THEN 'cleared' END AS part
  FROM (SELECT * FROM al WHERE look = 0) b FULL JOIN (SELECT * FROM al WHERE look = 1) a ON a.kind = b.kind AND a.key = b.key),
rk AS (SELECT kind, part, CASE WHEN kind = 'flood' AND part = 'cleared' THEN key WHEN kind = 'flood' THEN key || ': ' || label ELSE label END AS label, most, count(*) OVER (PARTITION BY kind, part) AS n, row_number() OVER (PARTITION BY kind, part ORDER BY CASE WHEN kind NOT IN ('flood', 'roads') THEN priority END, CASE WHEN kind NOT IN ('flood', 'roads') THEN label END, key) AS k FROM bo JOIN ls USING (kind) WHERE part IS NOT NULL)
SELECT kind, part, max(n) AS n, CASE WHEN part = 'escalated' OR kind NOT IN ('weather', 'storm') THEN string_agg(label, '; ' ORDER BY k) FILTER (k <= most) || CASE WHEN max(n) > max(most) THEN ' (+' || max(n) - max(most) || ' more)' ELSE '' END END AS text FROM rk GROUP BY kind, part""")
def alerts_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to announce between two looks, by hazard."""
    return alerts.changed(looked_at(spark, sf_dir, 0), looked_at(spark, sf_dir, 1))


@query(""", d AS (SELECT CAST(ts AS DATE) AS day, CAST(floor(sum(height)) AS BIGINT) AS off FROM obs GROUP BY 1), p AS (SELECT *, lag(off) OVER (ORDER BY day) AS was FROM d), l AS (SELECT *, CASE WHEN floor(off * 10 / k) > 20000 THEN 'high' WHEN floor(off * 10 / k) > 10000 THEN 'low' ELSE 'normal' END AS now, CASE WHEN floor(was * 10 / k) > 20000 THEN 'high' WHEN floor(was * 10 / k) > 10000 THEN 'low' WHEN was IS NOT NULL THEN 'normal' END AS before FROM p, (SELECT max(off) * 10 / 25000.0 AS k FROM d))
SELECT day, CASE WHEN before IS NULL THEN CASE WHEN now <> 'normal' THEN 'Monitor started — power is at ' || upper(now) || ' alert: ' ELSE NULL END WHEN now = before THEN NULL WHEN now = 'high' THEN 'High alert — ' WHEN now = 'low' THEN 'Low alert — ' ELSE 'Power recovered to normal — ' END || format('{:,}', CAST(floor(off * 10 / k) AS BIGINT)) || ' customers off supply.' AS message FROM l""")
def power_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the power level from day to day, of totals that are scaled to the thresholds."""
    d = observations(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.floor(F.sum("height")).alias("off"))
    scale = d.agg((F.max("off") * 10 / 25000.0).alias("k"))
    d = d.crossJoin(F.broadcast(scale)).select("day", F.floor(F.col("off") * 10 / F.col("k")).alias("off"))
    before = d.select(F.date_add("day", 1).alias("day"), F.col("off").alias("was"))
    return d.join(before, "day", "left").select("day", alerts.power(F.col("was"), F.col("off")).alias("message"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ident, first_seen, coalesce(nullif(trim(p_type), ''), 'Incident') || ' — ' || p_name AS item, p_partkey % 2 = 1 AS new FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey * 37 % 10000) AS first_seen FROM part WHERE p_size % 4 NOT IN (0, 1)) ORDER BY first_seen DESC, p_partkey DESC LIMIT 14""")
def incidents_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fourteen incidents, and which weren't listed at the look before."""
    k = F.col("p_partkey")
    seen_at = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(k * 37 % 10000).cast("int"))
    kind = F.when(F.col("p_size") % 4 == 0, "warning").when(F.col("p_size") % 4 == 1, "burn-area").otherwise("incident")
    rows = table(spark, sf_dir, "part").select(k.alias("source_id"), k.alias("seq"), kind.alias("feed_type"), F.col("p_type").alias("category1"), F.col("p_name").alias("location"), seen_at.alias("first_seen"))
    return alerts.incident_log(rows, rows.where("seq % 2 = 0").select(F.col("source_id").cast("string").alias("ident")))
