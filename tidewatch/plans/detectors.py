"""Detectors over orders, as histories of incidents, roads, warnings and outages, and over events, as gauges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.times import at
from tidewatch.operators import detect
from tidewatch.plans.registry import as_of, observations, query, table

CUTOFF = "1996-01-01 00:00:00"
C = f"TIMESTAMP '{CUTOFF}'"
#: Orders as polls of five hundred entities, in SQL.
POLLS = ", polls AS (SELECT o_custkey % 500 AS id, o_orderdate AS ts, o_orderkey AS seq, o_orderstatus AS status, CAST(floor(o_totalprice / 1000) AS DOUBLE) AS size FROM orders)"


def steps(source: str, value: str) -> str:
    """Changes of a metric of polls, with the value before and since when it held, in SQL."""
    over = "OVER (PARTITION BY id ORDER BY ts, seq)"
    return f"""{POLLS}, r AS (SELECT *, lag({value}) {over} AS pv, row_number() {over} AS n FROM (SELECT *, {value} AS v FROM ({source}))),
c AS (SELECT * FROM r WHERE n = 1 OR v <> pv), d AS (SELECT *, lag(ts) {over} AS since FROM c) """


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 500).alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("size"), F.col("o_orderdate").alias("first_seen"))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("entity_key", F.col("entity_key").cast("long"))


GRADE = "CASE status WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END"


@query(steps("SELECT * FROM polls WHERE id % 2 = 0", GRADE) + f"""SELECT CASE WHEN pv IS NULL THEN 'new' WHEN v < pv THEN 'escalation' ELSE 'downgrade' END AS kind, CASE WHEN v > pv THEN 0 WHEN v = 1 THEN 3 ELSE 2 END AS severity,
CASE WHEN pv IS NULL THEN 'New ' || l || ' issued' ELSE 'Warning ' || CASE WHEN v < pv THEN 'upgraded' ELSE 'downgraded' END || ' to ' || l || ' — Town ' || id END AS headline, ts, id AS entity_key, since
FROM (SELECT *, CASE v WHEN 1 THEN 'Emergency Warning' WHEN 2 THEN 'Watch and Act' ELSE 'Advice' END AS l FROM d) WHERE ts >= {C}""")
def warning_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community warnings issued, upgraded and downgraded."""
    s = F.col("status")
    level = F.when(s == "F", "Emergency Warning").when(s == "P", "Watch and Act").otherwise("Advice")
    polls = _polls(spark, sf_dir).where("id % 2 = 0").select(F.col("id").cast("string").alias("source_id"), "ts", "seq", F.lit("warning").alias("feed_type"), F.lit("Fire").alias("category1"), level.alias("warning_level"), F.lit(None).cast("string").alias("size"), F.concat(F.lit("Town "), F.col("id").cast("string"), F.lit(" - north")).alias("location"), "first_seen")
    return _key(detect.fire(polls, at(CUTOFF))).select("kind", "severity", "headline", "ts", "entity_key", "since")


@query(steps("SELECT * FROM polls WHERE id % 2 = 1", "size") + f"SELECT 'growth' AS kind, CASE WHEN v >= 1000 THEN 3 WHEN v >= 100 THEN 2 ELSE 1 END AS severity, ts, id AS entity_key, pv AS prev_value, v AS new_value, since FROM d WHERE ts >= {C} AND v - pv >= greatest(5, pv * 0.1) AND v > pv")
def fire_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents whose area grew by five hectares and a tenth."""
    polls = _polls(spark, sf_dir).where("id % 2 = 1").select(F.col("id").cast("string").alias("source_id"), "ts", "seq", F.lit("incident").alias("feed_type"), F.lit("Fire").alias("category1"), F.lit(None).cast("string").alias("warning_level"), F.concat(F.format_number("size", 2), F.lit(" Ha.")).alias("size"), F.lit("Town").alias("location"), "first_seen")
    return _key(detect.fire(polls, at(CUTOFF))).select("kind", "severity", "ts", "entity_key", "prev_value", "new_value", "since")


@query(steps("SELECT * FROM polls", "CAST(status = 'F' AS INT)") + f"""SELECT CASE WHEN v = 1 THEN 'new' ELSE 'cleared' END AS kind, CASE WHEN v = 1 THEN 1 ELSE 0 END AS severity, 'Road ' || id || CASE WHEN v = 1 THEN ' closed' ELSE ' reopened' END AS headline, ts, id AS entity_key, since
FROM d WHERE ts >= {C} AND (pv IS NOT NULL OR v = 1)""")
def road_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads that close and reopen."""
    polls = _polls(spark, sf_dir).select(F.col("id").cast("string").alias("source_id"), "ts", "seq", (F.col("status") == "F").alias("is_closure"), F.lit(0).alias("resolved"), F.concat(F.lit("Road "), F.col("id").cast("string")).alias("road_name"), F.lit(None).cast("string").alias("location"), "first_seen")
    return _key(detect.roads(polls, at(CUTOFF))).select("kind", "severity", "headline", "ts", "entity_key", "since")


ISSUES = POLLS + """, i AS (SELECT *, date_trunc('month', ts) AS issue, CAST(status <> 'F' AS INT) AS live FROM polls),
a AS (SELECT *, lag(issue) OVER w AS pv, row_number() OVER w AS n FROM i WHERE live = 1 WINDOW w AS (PARTITION BY id ORDER BY ts, seq)),
e AS (SELECT *, lag(live) OVER (PARTITION BY id ORDER BY ts, seq) AS pv FROM i)
"""


@query(ISSUES + f"""SELECT CASE WHEN n = 1 THEN 'new' ELSE 'reissued' END AS kind, CASE WHEN n = 1 AND id % 4 = 0 THEN 2 ELSE 1 END AS severity, issue AS ts, id AS entity_key FROM a WHERE (n = 1 AND ts >= {C}) OR (n > 1 AND issue <> pv AND issue >= {C})
UNION ALL SELECT 'cleared', 0, ts, id FROM e WHERE live = 0 AND pv = 1 AND ts >= {C}""")
def weather_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather warnings issued, issued again and cancelled."""
    polls = _polls(spark, sf_dir).select(F.col("id").alias("warning_id"), "ts", "seq", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("issue_time"), "first_seen", (F.col("status") != "F").alias("active"), F.when(F.col("id") % 4 == 0, "major").otherwise("minor").alias("group_type"), F.lit("flood_warning").alias("type"), F.lit("Warning").alias("title"))
    return _key(detect.weather(polls, at(CUTOFF))).select("kind", "severity", "ts", "entity_key")


@query(steps("SELECT * FROM polls", "size") + f"""SELECT CASE WHEN pv IS NULL THEN 'new' WHEN v > pv THEN 'growth' ELSE 'recovery' END AS kind, CASE WHEN pv IS NOT NULL AND v >= 5000 THEN 2 ELSE 1 END AS severity, ts, id AS entity_key, pv AS prev_value, v AS new_value, since
FROM d WHERE ts >= {C} AND ((pv IS NULL AND v >= 300) OR abs(v - pv) >= 300)""")
def outage_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages that begin, grow and shrink by hundreds of customers."""
    polls = _polls(spark, sf_dir).select(F.col("id").alias("location"), "ts", "seq", F.col("size").alias("customers_off"), "first_seen")
    return _key(detect.power_locations(polls, at(CUTOFF))).select("kind", "severity", "ts", "entity_key", "prev_value", "new_value", "since")


@query(""", s AS (SELECT ts, seq, height * 100 AS v FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-19 23:00:00' AND TIMESTAMP '2024-01-20 00:00:00'),
l AS (SELECT max(ts) AS ts, arg_max(v, (ts, seq)) AS v FROM s), a AS (SELECT coalesce(arg_max(s.v, (s.ts, s.seq)) FILTER (s.ts <= l.ts - INTERVAL 30 MINUTE), arg_min(s.v, (s.ts, s.seq))) AS was, any_value(l.ts) AS ts, any_value(l.v) AS v, count(*) AS n FROM s, l)
SELECT CASE WHEN v > was THEN 'deteriorating' ELSE 'improving' END AS kind, CASE WHEN v > was AND v >= 5000 THEN 2 ELSE 1 END AS severity, ts, was AS prev_value, v AS new_value FROM a WHERE n >= 2 AND abs(v - was) >= 500 AND abs(100 * (v - was) / was) >= 25""")
def power_situation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of outages against that of half an hour before."""
    series = observations(spark, sf_dir).select("ts", "seq", (F.col("height") * 100).alias("customers_off"))
    return detect.power_statewide(series, as_of(), at("2024-01-19 00:00:00")).select("kind", "severity", "ts", "prev_value", "new_value")


FAST = """, o AS (SELECT * FROM obs WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'), c AS (SELECT *, CASE WHEN height >= major THEN 1 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 3 ELSE 4 END AS now, lag(height) OVER (PARTITION BY station ORDER BY ts, seq) AS p FROM o),
x AS (SELECT *, CASE WHEN p >= major THEN 1 WHEN p >= moderate THEN 2 WHEN p >= minor THEN 3 ELSE 4 END AS before FROM c WHERE p IS NOT NULL AND ts >= TIMESTAMP '2024-01-18 00:00:00'),
k AS (SELECT CASE WHEN now < before THEN 'threshold' ELSE 'receding' END AS kind, CASE WHEN now > before THEN 0 WHEN now = 1 THEN 3 ELSE 2 END AS severity, ts, station AS entity_key, p AS prev_value, height AS new_value FROM x WHERE now <> before),
l AS (SELECT station, max(ts) AS t, arg_max(height, (ts, seq)) AS h, arg_max(now, (ts, seq)) AS now, any_value(minor) AS minor FROM c GROUP BY station),
a AS (SELECT o.station, any_value(t) AS t, any_value(l.h) AS h, any_value(now) AS now, any_value(l.minor) AS minor, count(*) FILTER (ts >= t - INTERVAL 60 MINUTE) AS n, arg_min(height, (ts, seq)) AS fh, min(ts) AS ft, arg_min(height, (ts, seq)) FILTER (ts >= t - INTERVAL 60 MINUTE) AS rh, min(ts) FILTER (ts >= t - INTERVAL 60 MINUTE) AS rt FROM o JOIN l USING (station) GROUP BY o.station),
b AS (SELECT *, CASE WHEN n >= 2 THEN rh ELSE fh END AS was, (epoch_us(t) - epoch_us(CASE WHEN n >= 2 THEN rt ELSE ft END)) / 3.6e9 AS hours FROM a)
"""


@query(FAST + """SELECT * FROM k UNION ALL SELECT 'rising', CASE WHEN now < 4 THEN 2 ELSE 1 END, t, station, was, h FROM b WHERE hours >= 5 / 60 AND (h - was) / hours >= 0.15 AND (now < 4 OR h >= 0.9 * minor) AND t >= TIMESTAMP '2024-01-18 00:00:00'
AND NOT EXISTS (SELECT 1 FROM k WHERE k.entity_key = b.station AND k.kind = 'threshold' AND k.ts >= b.t - INTERVAL 30 MINUTE)""")
def flood_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood classes crossed, and gauges that rise quickly near them."""
    found = detect.flood(observations(spark, sf_dir).where(F.col("ts") <= as_of()), at("2024-01-18 00:00:00"))
    return _key(found).select("kind", "severity", "ts", "entity_key", "prev_value", "new_value")


@query(""", n AS (SELECT station, ts, seq, height FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-19 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND height IS NOT NULL),
p AS (SELECT *, lag(height) OVER (PARTITION BY station ORDER BY ts, seq) AS q FROM n), t AS (SELECT station, count(*) AS c, max(ts) AS ts, min(ts) AS since, sum(CASE WHEN q IS NULL THEN 0 WHEN height >= q THEN height - q ELSE height END) AS total FROM p GROUP BY station)
SELECT station AS entity_key, CASE WHEN total >= 200 THEN 2 ELSE 1 END AS severity, ts, since, round(total, 4) AS new_value FROM t WHERE c >= 2 AND total >= 100""")
def rain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations whose counters grew much within a day."""
    rows = observations(spark, sf_dir).select(F.col("station").alias("wmo"), "ts", "seq", F.lit(None).cast("string").alias("name"), F.col("height").alias("rain"))
    found = detect.rainfall(rows, as_of(), at("2024-01-19 00:00:00"), window_minutes=1440, burst=100.0)
    return _key(found).select("entity_key", "severity", "ts", "since", F.round("new_value", 4).alias("new_value"))


@query(steps("SELECT * FROM polls", "CAST(status = 'F' AS INT)") + f"""SELECT kind, ts, id AS entity_key FROM (SELECT DISTINCT CASE WHEN v = 1 THEN 'new' ELSE 'cleared' END AS kind, ts, id FROM d WHERE ts >= {C} AND (pv IS NOT NULL OR v = 1)) WHERE ts >= TIMESTAMP '1997-01-01 00:00:00'""")
def detector_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass of detectors adds to entries stored by an earlier pass."""
    polls = _polls(spark, sf_dir).select(F.col("id").cast("string").alias("source_id"), "ts", "seq", (F.col("status") == "F").alias("is_closure"), F.lit(0).alias("resolved"), F.lit("Road").alias("road_name"), F.lit(None).cast("string").alias("location"), "first_seen")
    found = detect.roads(polls, at(CUTOFF))
    return _key(detect.additions(found.where(F.col("ts") < at("1997-01-01 00:00:00")), found, found)).select("kind", "ts", "entity_key")
