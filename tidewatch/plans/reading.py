"""Read models over events and orders: figures at a time, timeline, coverage, ticker, watch points, briefing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.classify import source_state
from tidewatch.functions.times import at, minutes_between
from tidewatch.operators import detect, trend, views
from tidewatch.plans.detectors import FAST
from tidewatch.plans.registry import ORDERS_AS_OF, as_of, journal, observations, query, table
from tidewatch.plans.water import TREND_SQL

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly figures, as collectors write them after a cycle."""
    return observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"), F.count_if(F.col("catchment") == "error").alias("errors"), F.max("seq").alias("seq"))


KPIS = ", h AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS n, count(*) FILTER (catchment = 'error') AS errors FROM obs GROUP BY 1)"


@query(KPIS + f""", k AS (SELECT arg_max(n, ts) AS n, arg_max(errors, ts) AS e FROM h WHERE ts BETWEEN {NOW} - INTERVAL 6 HOUR AND {NOW})
SELECT 0 AS position, 'Readings' AS label, format('{{:,}}', n) AS value FROM k UNION ALL SELECT 1, 'Errors', format('{{:,}}', e) FROM k UNION ALL SELECT 2, 'Tomorrow', '—'
UNION ALL SELECT 3, 'Gauges ≥ Minor', CAST(count(*) FILTER (priority <= 3) AS VARCHAR) FROM classed WHERE ts >= {NOW} - INTERVAL 24 HOUR""")
def historical_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures as they stood; what no collector wrote is unknown."""
    c = _counts(spark, sf_dir)
    later = c.where(F.col("ts") > as_of())
    return views.historical_kpis([("Readings", c, "n"), ("Errors", c, "errors"), ("Tomorrow", later, "n")], observations(spark, sf_dir), as_of())


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.flood(observations(spark, sf_dir).where(F.col("ts") <= as_of()), at("2024-01-18 00:00:00"))


RISING = """, f AS (SELECT * FROM k UNION ALL SELECT 'rising', CASE WHEN now < 4 THEN 2 ELSE 1 END, t, station, was, h FROM b WHERE hours >= 5 / 60 AND (h - was) / hours >= 0.15 AND (now < 4 OR h >= 0.9 * minor) AND t >= TIMESTAMP '2024-01-18 00:00:00'
AND NOT EXISTS (SELECT 1 FROM k WHERE k.entity_key = b.station AND k.kind = 'threshold' AND k.ts >= b.t - INTERVAL 30 MINUTE))
"""


@query(FAST + RISING + f"SELECT kind, severity, ts, CAST(entity_key AS VARCHAR) AS entity_key FROM f WHERE severity >= 1 AND ts BETWEEN {NOW} - INTERVAL 6 HOUR AND {NOW} ORDER BY ts DESC, CAST(entity_key AS VARCHAR), kind LIMIT 40")
def significant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing's changes of six hours, the gravest first."""
    return views.significant(_entries(spark, sf_dir), as_of() - F.expr("INTERVAL 6 HOURS"), as_of()).select("kind", "severity", "ts", "entity_key")


@query(FAST + RISING + f"SELECT kind, severity, ts, CAST(entity_key AS VARCHAR) AS entity_key FROM f WHERE severity >= 1 AND ts BETWEEN {NOW} - INTERVAL 48 HOUR AND {NOW} ORDER BY ts DESC, CAST(entity_key AS VARCHAR), kind LIMIT 200")
def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's entries, oldest first."""
    return views.timeline(_entries(spark, sf_dir), as_of() - F.expr("INTERVAL 48 HOURS"), as_of()).select("kind", "severity", "ts", "entity_key")


@query("SELECT source, min(effective_ts) AS available_from, (SELECT max(m) FROM (SELECT min(effective_ts) AS m FROM journal GROUP BY source)) AS journal_from, TIMESTAMP '1997-01-01 00:00:00' >= (SELECT max(m) FROM (SELECT min(effective_ts) AS m FROM journal GROUP BY source)) AS full_fidelity FROM journal GROUP BY source")
def replay_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From when on each source can be replayed, and whether an event lies after all of them."""
    return views.coverage(journal(spark, sf_dir), at(ORDERS_AS_OF))


@query(f""", o AS (SELECT * FROM obs WHERE ts <= {NOW}), s AS (SELECT station, max(ts) FILTER (height < minor) AS below FROM o GROUP BY station)
SELECT station, priority, min(o.ts) AS crossed_at FROM o JOIN s USING (station) JOIN (SELECT station, priority FROM classed) USING (station) WHERE priority < 4 AND below IS NOT NULL AND o.ts > below GROUP BY station, priority""")
def flood_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the gauges that are in flood crossed into it."""
    return views.crossings(observations(spark, sf_dir), as_of())


@query(f""", past AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '{ORDERS_AS_OF}'), o AS (SELECT * FROM obs WHERE ts <= {NOW}), s AS (SELECT station, max(ts) FILTER (height < minor) AS below FROM o GROUP BY station),
x AS (SELECT o_orderdate AS ts, o_orderkey % 500 = 0 AS emergency, CASE WHEN o_orderkey % 500 = 0 THEN 'SEWS — ' ELSE '' END || 'Warning ' || o_orderkey AS item FROM past WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderdate, o_orderkey % 400 = 1, CASE WHEN o_orderkey % 400 = 1 THEN 'Emergency Warning' ELSE 'Advice' END || ' — Town ' || o_orderkey FROM past WHERE o_orderstatus = 'O'
UNION ALL SELECT min(o.ts), false, station || ' — ' || CASE priority WHEN 1 THEN 'Major flooding' WHEN 2 THEN 'Moderate flooding' ELSE 'Minor flooding' END FROM o JOIN s USING (station) JOIN (SELECT station, priority FROM classed) USING (station) WHERE priority < 4 AND below IS NOT NULL AND o.ts > below GROUP BY station, priority)
SELECT ts, emergency, item FROM x WHERE emergency OR ts >= {NOW} - INTERVAL 24 HOUR""")
def ticker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker: warnings and crossings of a day, and emergencies of any age."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= at(ORDERS_AS_OF))
    key = F.col("o_orderkey").cast("string")
    weather = o.where("o_orderstatus = 'P'").select(F.concat(F.lit("Warning "), key).alias("title"), F.when(F.col("o_orderkey") % 500 == 0, "Standard Emergency Warning Signal").alias("message"), F.col("o_orderdate").alias("first_seen"), F.lit(1).alias("active"))
    warnings = o.where("o_orderstatus = 'O'").select(F.when(F.col("o_orderkey") % 400 == 1, "Emergency Warning").otherwise("Advice").alias("warning_level"), F.concat(F.lit("Town "), key).alias("location"), F.lit("").alias("event"), F.col("o_orderdate").alias("first_seen"), F.lit(0).alias("resolved"))
    return views.ticker(weather, warnings, observations(spark, sf_dir), as_of(), minutes=1440)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("ts") > at("2024-01-15 00:00:00")) & (F.col("ts") <= as_of()))
    analysed = trend.analyse(trend.fits(rows.select("station", "ts", "seq", "height"), "station"), 40 + F.col("station") % 20 + 100, horizon_h=240.0)
    cells = rows.select(F.concat(F.lit("C-"), F.col("seq").cast("string")).alias("cell_id"), F.when(F.col("height") >= 120, "strong").when(F.col("height") >= 60, "moderate").otherwise("weak").alias("classification"), F.col("height").alias("intensity_score"), F.col("height").alias("speed_kmh"), (F.col("seq") % 360).cast("double").alias("bearing_deg"), (F.col("height") * 2).alias("area_km2"))
    gusts = rows.select(F.concat(F.lit("Station "), F.col("station").cast("string")).alias("name"), F.col("height").alias("gust")).groupBy("name").agg(F.max("gust").alias("gust"))
    return views.watch_points(analysed, cells, gusts, near_m=50.0)


@query(TREND_SQL + f""", near AS (SELECT *, target - current AS d, CASE WHEN rate >= 0.02 AND (target - current) / rate <= 240 THEN (target - current) / rate END AS eta FROM a WHERE target > current AND target - current <= 50 AND rate > 0 ORDER BY target - current, station LIMIT 8),
strong AS (SELECT * FROM obs WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= {NOW} AND height >= 60 ORDER BY height DESC, 'C-' || seq LIMIT 4), gu AS (SELECT 'Station ' || station AS name, max(height) AS gust FROM obs WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= {NOW} GROUP BY station HAVING max(height) >= 70 ORDER BY max(height) DESC, name LIMIT 3),
wp AS (SELECT 1 AS part, row_number() OVER (ORDER BY d, station) AS k, CASE WHEN eta IS NOT NULL THEN 'PROJECTION' ELSE 'OBSERVED' END AS kind, CAST(station AS VARCHAR) AS title, list_filter([printf('%.2f m below %.2f m · rising %+.2f m/hr', CAST(d AS DOUBLE), CAST(target AS DOUBLE), rate), CASE WHEN eta IS NOT NULL THEN printf('Projected to reach it in about %.1f hr; not an official forecast', eta) END], lambda l: l IS NOT NULL) AS lines FROM near
UNION ALL SELECT 2, row_number() OVER (ORDER BY height DESC, 'C-' || seq), 'OBSERVED', 'Storm cell C-' || seq, [CASE WHEN height >= 120 THEN 'Strong' ELSE 'Moderate' END || ' · ' || ['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW'][1 + CAST(floor(seq % 360 / 22.5 + 0.5) AS INTEGER) % 16] || printf(' at %.0f km/h', height) || printf(' · ~%.0f km²', height * 2)] FROM strong
UNION ALL SELECT 3, 1, 'OBSERVED', 'Strong wind gusts observed', list(name || printf(' — %.0f km/h', gust) ORDER BY gust DESC, name) FROM gu HAVING count(*) > 0)
SELECT CAST(row_number() OVER (ORDER BY part, k) AS INTEGER) AS position, kind, title, array_to_string(lines, '; ') AS lines FROM wp QUALIFY position <= 8""")
def watch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is short of its worst threshold and deserves attention."""
    return _points(spark, sf_dir).withColumn("lines", F.array_join("lines", "; "))


@query()
def briefing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The briefing, a row for each line."""
    changes = views.significant(_entries(spark, sf_dir), as_of() - F.expr("INTERVAL 1 HOUR"), as_of())
    warnings = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5).select(F.col("o_orderpriority").alias("level"), F.concat(F.lit("Warning "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderdate").alias("issued"))
    last = observations(spark, sf_dir).where(F.col("ts") <= as_of()).groupBy(F.col("catchment").alias("source")).agg(F.max("ts").alias("ts"))
    age = minutes_between(F.col("ts"), as_of())
    sources = last.select("source", age.alias("age"), source_state(age, F.lit(10)).alias("state"))
    return views.briefing(as_of(), 60, historical_kpis(spark, sf_dir), changes, warnings, _points(spark, sf_dir), sources)


@query(f""", s(name, n, first_ts, last_ts) AS (SELECT 'gauges', count(*), min(ts), max(ts) FROM obs WHERE ts BETWEEN {NOW} - INTERVAL 2 DAY AND {NOW} UNION ALL SELECT 'journal', count(*), min(effective_ts), max(effective_ts) FROM journal WHERE effective_ts BETWEEN {NOW} - INTERVAL 2 DAY AND {NOW})
SELECT name, n AS "rows", first_ts, last_ts FROM s""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of two days holds."""
    return views.summary(spark, {"gauges": (observations(spark, sf_dir), "ts"), "journal": (journal(spark, sf_dir), "effective_ts")}, as_of() - F.expr("INTERVAL 2 DAYS"), as_of())
