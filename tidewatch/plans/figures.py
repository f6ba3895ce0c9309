"""Figures of the situation over events, orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import at
from tidewatch.operators import figures
from tidewatch.plans.registry import as_of, observations, query, table
from tidewatch.plans.water import latest_classed

NOW = "TIMESTAMP '2024-01-20 00:00:00'"
#: Parts as weather warnings and incidents, cells of error readings of the last hours.
THINGS = f""", ww AS (SELECT p_partkey AS seq, ['flood_watch', 'severe_storm', 'severe_flood', NULL][1 + p_size % 4] AS type, ['Major', 'severe', 'minor', NULL][1 + p_partkey % 4] AS group_type, p_name AS title, CAST(p_partkey % 3 = 0 AS INT) AS active, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey * 37 % 20000) AS issue_time FROM part),
fi AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'warning' ELSE 'incident' END AS feed_type, ['Emergency Warning', ' Watch and Act', 'Advice', 'Community Information'][1 + p_size % 4] AS warning_level, ['Fire', 'Tree Down', NULL][1 + p_partkey % 3] AS category1, p_name AS location, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(p_partkey * 53 % 20000) AS updated, CAST(p_partkey % 5 = 0 AS INT) AS resolved FROM part),
ce AS (SELECT station AS cell_id, ts, seq, height AS intensity_score, CASE WHEN height >= 80 THEN 'strong' WHEN height >= 40 THEN 'moderate' ELSE 'weak' END AS classification FROM obs WHERE catchment = 'error' AND ts >= {NOW} - INTERVAL 48 HOUR AND ts <= {NOW})
"""


def _warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (c % len(xs) + 1).cast("int"))
    made = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(k * 37 % 20000).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("seq"), pick(F.col("p_size"), "flood_watch", "severe_storm", "severe_flood", None).alias("type"), pick(k, "Major", "severe", "minor", None).alias("group_type"), F.col("p_name").alias("title"), (k % 3 == 0).cast("int").alias("active"), made.alias("issue_time"))


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda c, *xs: F.element_at(F.array(*[F.lit(x).cast("string") for x in xs]), (c % len(xs) + 1).cast("int"))
    updated = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(k * 53 % 20000).cast("int"))
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        k.alias("seq"), F.when(k % 2 == 0, "warning").otherwise("incident").alias("feed_type"), pick(F.col("p_size"), "Emergency Warning", " Watch and Act", "Advice", "Community Information").alias("warning_level"), null.alias("event"), pick(k, "Fire", "Tree Down", None).alias("category1"), null.alias("category2"),
        F.col("p_name").alias("location"), null.alias("headline"), updated.alias("created"), updated.alias("updated"), (k % 5 == 0).cast("int").alias("resolved"),
    )


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("height")
    rows = observations(spark, sf_dir).where("catchment = 'error'").where(F.col("ts").between(as_of() - F.expr("INTERVAL 48 HOURS"), as_of()))
    return rows.select(F.col("station").alias("cell_id"), "ts", "seq", h.alias("intensity_score"), F.when(h >= 80, "strong").when(h >= 40, "moderate").otherwise("weak").alias("classification"))


@query(THINGS + f""", pw AS (SELECT CAST(floor(arg_max(height, (ts, seq)) * 300) AS BIGINT) AS off FROM obs WHERE ts <= {NOW}),
fg AS (SELECT count(*) FILTER (priority <= 3) AS minor, count(*) FILTER (priority <= 2) AS moderate, count(*) FILTER (priority = 1) AS major FROM classed),
ff AS (SELECT count(*) FILTER (feed_type <> 'warning' AND lower(category1) = 'fire') AS active, count(*) FILTER (feed_type = 'warning' AND warning_level = 'Emergency Warning') AS emergency, count(*) FILTER (feed_type = 'warning' AND warning_level = ' Watch and Act') AS watch FROM fi WHERE resolved = 0),
rd AS (SELECT count(*) FILTER (s_suppkey % 4 <> 0) AS total, count(*) FILTER (s_suppkey % 4 <> 0 AND s_nationkey % 2 = 1) AS closures FROM supplier), sc AS (SELECT count(*) FILTER (classification <> 'weak') AS n, count(*) FILTER (classification = 'strong') AS strong FROM ce),
wt AS (SELECT max(height) AS v, arg_max(station, (height, station)) AS s FROM classed), wc AS (SELECT count(*) AS n FROM ww WHERE active = 1)
SELECT 0 AS position, 'Customers Without Power' AS label, format('{{:,}}', off) AS value, off > 20000 AS alert, CAST(NULL AS VARCHAR) AS detail FROM pw UNION ALL SELECT 1, 'Gauges ≥ Minor', CAST(minor AS VARCHAR), minor > 0, NULL FROM fg UNION ALL SELECT 2, 'Gauges ≥ Moderate', CAST(moderate AS VARCHAR), moderate > 0, NULL FROM fg UNION ALL SELECT 3, 'Gauges ≥ Major', CAST(major AS VARCHAR), major > 0, NULL FROM fg
UNION ALL SELECT 4, 'Active Fires', CAST(active AS VARCHAR), active > 0, NULL FROM ff UNION ALL SELECT 5, 'Emergency Warnings', CAST(emergency AS VARCHAR), emergency > 0, NULL FROM ff UNION ALL SELECT 6, 'Watch & Act', CAST(watch AS VARCHAR), watch > 0, NULL FROM ff UNION ALL SELECT 7, 'Active BoM Warnings', CAST(n AS VARCHAR), n > 0, NULL FROM wc
UNION ALL SELECT 8, 'Road Disruptions', CAST(total AS VARCHAR), false, NULL FROM rd UNION ALL SELECT 9, 'Full Closures', CAST(closures AS VARCHAR), closures > 0, NULL FROM rd UNION ALL SELECT 10, 'Storm Cells (mod/strong)', CAST(n AS VARCHAR), strong > 0, NULL FROM sc UNION ALL SELECT 11, 'Wettest Station (since 9am)', format('{{:.1f}}', round(v, 1)) || ' mm', false, CAST(s AS VARCHAR) FROM wt""")
def situation_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve figures of a briefing."""
    obs = observations(spark, sf_dir).where(F.col("ts") <= as_of())
    power = obs.select("ts", "seq", F.floor(F.col("height") * 300).alias("customers_off"))
    roads = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2).alias("is_closure"), (F.col("s_suppkey") % 4 == 0).cast("int").alias("resolved"))
    latest = latest_classed(spark, sf_dir)
    rain = latest.select("station", F.round("height", 1).alias("value"), "height")
    wettest = rain.orderBy(F.desc("height"), F.desc("station")).limit(1).select("station", "value")
    return figures.situation(power, latest, _incidents(spark, sf_dir), _warnings(spark, sf_dir), roads, _cells(spark, sf_dir), wettest)


@query(THINGS + """SELECT count(*) AS total, count(*) FILTER (contains(coalesce(type, ''), 'flood')) AS flood, count(*) FILTER (contains(coalesce(type, ''), 'severe')) AS severe, count(*) FILTER (lower(group_type) IN ('major', 'severe')) AS major FROM ww WHERE active = 1""")
def weather_warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.warning_counts(_warnings(spark, sf_dir))


@query(THINGS + "SELECT count(*) AS total, count(*) FILTER (classification = 'strong') AS strong, count(*) FILTER (classification = 'moderate') AS moderate, CAST(coalesce(trunc(max(intensity_score)), 0) AS INTEGER) AS max_intensity FROM ce")
def storm_cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.storm_counts(_cells(spark, sf_dir))


@query(THINGS + f"SELECT ce.* FROM ce JOIN (SELECT cell_id FROM ce WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY cell_id ORDER BY max(intensity_score) DESC, cell_id LIMIT 12) USING (cell_id) WHERE ts >= {NOW} - INTERVAL 24 HOUR")
def strongest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's rows of the twelve strongest storm cells."""
    return figures.cell_history(_cells(spark, sf_dir), as_of() - F.expr("INTERVAL 24 HOURS"))


@query(""", s AS (SELECT date_trunc('hour', ts) AS ts, count(*) FILTER (catchment = 'error') AS e, CASE WHEN count(*) % 3 <> 0 THEN count(*) FILTER (catchment = 'view') END AS w, count(*) FILTER (catchment = 'click') AS a, count(*) // 2 AS t FROM obs GROUP BY 1)
SELECT ts, e + coalesce(w, 0) + a AS warnings_total, greatest(0, t - (e + coalesce(w, 0) + a)) AS incidents_total FROM s""")
def fire_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and other incidents hour by hour."""
    c = F.col("catchment")
    rows = observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count_if(c == "error").alias("emergency_warnings"), F.when(F.count("*") % 3 != 0, F.count_if(c == "view")).alias("watch_act"), F.count_if(c == "click").alias("advice"), F.floor(F.count("*") / 2).alias("total_active"))
    return figures.fire_totals(rows).select("ts", "warnings_total", "incidents_total")


@query(""", w(label, span) AS (VALUES ('1h', INTERVAL 1 HOUR), ('6h', INTERVAL 6 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 7 DAY)), l AS (SELECT max(ts) AS t FROM obs)
SELECT label, max(height) AS peak, arg_max(ts, (height, -epoch_us(ts))) AS peak_ts FROM w, l JOIN obs ON ts >= t - INTERVAL 7 DAY WHERE ts >= t - span GROUP BY label""")
def peaks_before_the_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak of each of four spans before the newest reading."""
    return figures.peaks(observations(spark, sf_dir), "height", {"1h": "1 HOUR", "6h": "6 HOURS", "24h": "24 HOURS", "7d": "7 DAYS"})


@query(""", m AS (SELECT station, ts, seq, CASE WHEN seq % 9 <> 0 THEN floor(height / 40) + (seq % 2) * 1e-10 END AS value, CASE WHEN height >= 80 THEN 'high' WHEN seq % 7 <> 0 THEN 'low' END AS label FROM obs),
l AS (SELECT *, lag(value) OVER w AS pv, lag(label) OVER w AS pl, lag(seq) OVER w AS q FROM m WINDOW w AS (PARTITION BY station ORDER BY ts, seq))
SELECT station, ts, seq, round(value, 6) AS value, label FROM l WHERE q IS NULL OR NOT (coalesce(abs(value - pv) < 1e-9, value IS NULL AND pv IS NULL) AND label IS NOT DISTINCT FROM pl)""")
def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric's changes in value, by more than a tolerance, or in label."""
    s, h = F.col("seq"), F.col("height")
    rows = observations(spark, sf_dir).select("station", "ts", "seq", F.when(s % 9 != 0, F.floor(h / 40) + (s % 2) * 1e-10).alias("value"), F.when(h >= 80, "high").when(s % 7 != 0, "low").alias("label"))
    return figures.metric_records(rows, ["station"], "ts", "seq", "value", "label").select("station", "ts", "seq", F.round("value", 6).alias("value"), "label")


BRIEFED = THINGS + """, va AS (SELECT *, CASE trim(warning_level) WHEN 'Emergency Warning' THEN 0 WHEN 'Watch and Act' THEN 1 WHEN 'Advice' THEN 2 END AS grade FROM fi WHERE feed_type = 'warning' AND resolved = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY updated DESC, seq) AS k FROM va WHERE grade IS NOT NULL),
wr AS (SELECT *, CASE lower(group_type) WHEN 'major' THEN 1 WHEN 'severe' THEN 1 WHEN 'moderate' THEN 2 WHEN 'minor' THEN 3 ELSE 4 END AS grade FROM ww WHERE active = 1)
"""


@query(BRIEFED + """SELECT CAST(row_number() OVER (ORDER BY authority, grade, issued DESC, seq) - 1 AS INTEGER) AS position, source, level, kind, title, issued FROM (SELECT 0 AS authority, grade, seq, 'VicEmergency' AS source, trim(warning_level) AS level, coalesce(category1, 'Incident') AS kind, location AS title, updated AS issued FROM vr WHERE grade < 2 OR k <= 5
UNION ALL SELECT 1, grade, seq, 'BoM', NULL, coalesce(CASE type WHEN 'flood_watch' THEN 'Flood Watch' WHEN 'severe_storm' THEN 'Severe Storm' WHEN 'severe_flood' THEN 'Severe Flood' END, 'Warning'), title, issue_time FROM wr)""")
def briefing_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active warnings of both authorities, the gravest first, with five of advice at most."""
    return figures.briefing_warnings(_incidents(spark, sf_dir), _warnings(spark, sf_dir))[0]


@query(BRIEFED + "SELECT count(*) AS omitted FROM vr WHERE grade = 2 AND k > 5")
def briefing_warnings_omitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return figures.briefing_warnings(_incidents(spark, sf_dir), _warnings(spark, sf_dir))[1]


@query(""", s AS (SELECT station, CASE WHEN station % 4 <> 0 THEN CAST(floor(height) AS DOUBLE) END AS gust, station % 50 + 20 AS humidity, CAST(floor(height) AS DOUBLE) + 0.5 AS rain, station % 90 AS daily, CASE WHEN station % 2 = 0 THEN '02:40pm' END AS t FROM classed)
SELECT 0 AS position, 'Strongest current gust' AS label, CAST(CAST(max(gust) AS BIGINT) AS VARCHAR) || ' km/h' AS value, CAST(arg_min(station, (-gust, station)) FILTER (gust IS NOT NULL) AS VARCHAR) AS detail FROM s UNION ALL SELECT 1, 'Lowest relative humidity', min(humidity) || '%', CAST(arg_min(station, (humidity, station)) AS VARCHAR) FROM s
UNION ALL SELECT 2, 'Wettest since 9am', format('{:.1f}', max(rain)) || ' mm', CAST(arg_min(station, (-rain, station)) AS VARCHAR) FROM s UNION ALL SELECT 3, 'Highest gust today', max(daily) || ' km/h', arg_min(station || coalesce(' (' || t || ')', ''), (-daily, station)) FROM s""")
def weather_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weather of a briefing: extremes of the stations' latest readings."""
    s = F.col("station")
    whole = F.floor("height").cast("double")
    rows = latest_classed(spark, sf_dir).select("station", F.when(s % 4 != 0, whole).alias("gust"), (s % 50 + 20).alias("humidity"), (whole + 0.5).alias("rain"), (s % 90).alias("daily_gust"), F.when(s % 2 == 0, "02:40pm").alias("daily_gust_time"))
    return figures.weather_block(rows)


@query("SELECT p_name, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def towns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One guide for each name: the first."""
    return figures.first_seen_order(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), "p_name", ["p_partkey"])


@query()
def briefing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing with all of its sections, a row for each line; the parts have queries with SQL of their own."""
    from tidewatch.functions.classify import source_state
    from tidewatch.functions.times import minutes_between
    from tidewatch.operators import report
    from tidewatch.plans import reading, situations

    rows = situations.feed_with_context(spark, sf_dir)
    changes = rows.join(situations.changes(spark, sf_dir).select(F.col("event_id").alias("id"), "ts", "severity", "headline"), "id").select("severity", "ts", "headline", F.split("lines", "; ").alias("lines"))
    warnings, omitted = figures.briefing_warnings(_incidents(spark, sf_dir), _warnings(spark, sf_dir))
    consequences = situations.emerging_consequences(spark, sf_dir).select("position", "title", F.split("lines", "; ").alias("lines"))
    last = observations(spark, sf_dir).where(F.col("ts") <= as_of()).groupBy(F.col("catchment").alias("source")).agg(F.max("ts").alias("ts"))
    age = minutes_between(F.col("ts"), as_of())
    sources = last.select("source", age.alias("age"), source_state(age, F.lit(10)).alias("state"))
    return report.report(as_of(), 1440, situation_figures(spark, sf_dir), changes, warnings, omitted, consequences, reading._points(spark, sf_dir), weather_block(spark, sf_dir), sources)
