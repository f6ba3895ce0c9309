"""Gauges, rain and weather stations, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions.classify import flood_label, flood_priority, lead_bucket
from tidewatch.functions.times import at
from tidewatch.operators import changes, folds, temporal, trend
from tidewatch.plans.registry import as_of, coords, instants, observations, query, table


def latest_classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.latest(observations(spark, sf_dir).where(F.col("ts") <= as_of()), ["station"], ["ts", "seq"])
    return rows.withColumn("priority", flood_priority(F.col("height"), F.col("minor"), F.col("moderate"), F.col("major")))


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.with_previous(observations(spark, sf_dir), ["station"], "ts", "seq", ["height", "ts"])


@query("SELECT station, ts, height, catchment, seq FROM latest")
def latest_per_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_classed(spark, sf_dir).select("station", "ts", "height", "catchment", "seq")


@query("SELECT count(*) FILTER (priority <= 1) AS major, count(*) FILTER (priority <= 2) AS moderate, count(*) FILTER (priority <= 3) AS minor, count(*) AS total FROM classed")
def flooding_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many gauges are at or above each flood level; the graver ones count in the lesser, too."""
    p = F.col("priority")
    return latest_classed(spark, sf_dir).agg(F.count_if(p <= 1).alias("major"), F.count_if(p <= 2).alias("moderate"), F.count_if(p <= 3).alias("minor"), F.count("*").alias("total"))


LABELS = "CASE priority WHEN 1 THEN 'Major flooding' WHEN 2 THEN 'Moderate flooding' WHEN 3 THEN 'Minor flooding' ELSE 'Below flood level' END"


@query(f"SELECT station, height, priority, {LABELS} AS label FROM classed")
def classify_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_classed(spark, sf_dir).select("station", "height", "priority", flood_label(F.col("priority")).alias("label"))


@query("SELECT c.station, height, priority, round(lat, 6) AS lat, round(lon, 6) AS lon FROM classed c JOIN coords USING (station)")
def flood_map_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest_classed(spark, sf_dir).join(coords(spark, sf_dir), "station")
    return rows.select("station", "height", "priority", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SELECT count(*) FILTER (priority <= 3) AS minor, count(*) AS total FROM classed JOIN coords USING (station) WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'")
def replay_gauge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As replay counts gauges: those with a place and a reading of the last 24 hours."""
    rows = latest_classed(spark, sf_dir).where(F.col("ts") >= as_of() - F.expr("INTERVAL 24 HOURS")).join(coords(spark, sf_dir), "station", "left_semi")
    return rows.agg(F.count_if(F.col("priority") <= 3).alias("minor"), F.count("*").alias("total"))


@query("SELECT station, height, priority FROM classed WHERE priority <= 3 ORDER BY priority, station LIMIT 12")
def flooding_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gravest twelve, for graphs."""
    return latest_classed(spark, sf_dir).where("priority <= 3").select("station", "height", "priority").orderBy("priority", "station").limit(12)


@query("SELECT catchment, count(DISTINCT station) AS stations, count(*) AS readings, max(ts) AS last_ts FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY catchment")
def catchment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where(F.col("ts").between(at("2024-01-05 00:00:00"), at("2024-01-12 00:00:00")))
    return rows.groupBy("catchment").agg(F.countDistinct("station").alias("stations"), F.count("*").alias("readings"), F.max("ts").alias("last_ts"))


@query("SELECT station, ts, height FROM obs WHERE station = 7 AND ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'")
def station_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("station") == 7) & (F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= as_of()))
    return rows.select("station", "ts", "height")


@query("SELECT station, round(sum(CASE WHEN prev_height IS NULL THEN 0 WHEN height >= prev_height THEN height - prev_height ELSE height END), 4) AS total, count(*) AS readings FROM prev GROUP BY station")
def reset_proof_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.reset_total(observations(spark, sf_dir), ["station"], "ts", "seq", "height")
    return out.select("station", F.round("total", 4).alias("total"), "readings")


@query(""", w AS (SELECT station, date_trunc('hour', ts) AS hour, ts, seq, height FROM obs),
p AS (SELECT *, lag(height) OVER (PARTITION BY station, hour ORDER BY ts, seq) AS q FROM w),
t AS (SELECT station, hour, count(*) AS readings, sum(CASE WHEN q IS NULL THEN 0 WHEN height >= q THEN height - q ELSE height END) AS total FROM p GROUP BY ALL)
SELECT station, hour, readings, round(total, 4) AS total, CASE WHEN total >= 20 THEN 2 ELSE 1 END AS severity FROM t WHERE readings >= 2 AND total >= 10""")
def rain_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a gauge's counter grew by 10 or more, restarts allowed for."""
    rows = observations(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    out = temporal.reset_total(rows, ["station", "hour"], "ts", "seq", "height").where("readings >= 2 AND total >= 10")
    return out.select("station", "hour", "readings", F.round("total", 4).alias("total"), F.when(F.col("total") >= 20, 2).otherwise(1).alias("severity"))


@query(""", fresh AS (SELECT * FROM latest WHERE ts >= (SELECT max(ts) FROM latest) - INTERVAL 6 HOUR)
SELECT (SELECT count(*) FROM latest) AS stations, count(*) AS reporting, (SELECT count(*) FROM latest) - count(*) AS stale,
max(height) AS highest, arg_max(station, (height, -station)) AS highest_station, min(height) AS lowest, arg_min(station, (height, station)) AS lowest_station FROM fresh""")
def network_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes among stations that reported within six hours of the newest reading of all."""
    rows = latest_classed(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("newest")))).withColumn("fresh", F.col("ts") >= F.col("newest") - F.expr("INTERVAL 6 HOURS"))
    h = F.when(F.col("fresh"), F.col("height"))
    return rows.agg(
        F.count("*").alias("stations"), F.count_if("fresh").alias("reporting"), F.count_if(~F.col("fresh")).alias("stale"), F.max(h).alias("highest"),
        F.max_by("station", F.when(h.isNotNull(), F.struct(h.alias("h"), (-F.col("station")).alias("s")))).alias("highest_station"), F.min(h).alias("lowest"),
        F.min_by("station", F.when(h.isNotNull(), F.struct(h.alias("h"), F.col("station").alias("s")))).alias("lowest_station"),
    )


@query("SELECT station, height FROM latest ORDER BY height DESC NULLS LAST, station LIMIT 3")
def ranked_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_classed(spark, sf_dir).select("station", "height").orderBy(F.desc_nulls_last("height"), "station").limit(3)


CLASS = "CASE WHEN {0} >= major THEN 1 WHEN {0} >= moderate THEN 2 WHEN {0} >= minor THEN 3 ELSE 4 END"


@query(f""", c AS (SELECT *, {CLASS.format("height")} AS now, {CLASS.format("prev_height")} AS before FROM prev WHERE prev_height IS NOT NULL)
SELECT station, ts, before, now, CASE WHEN now < before THEN 'threshold' ELSE 'receding' END AS kind, CASE WHEN now > before THEN 0 WHEN now = 1 THEN 3 ELSE 2 END AS severity FROM c WHERE now <> before""")
def class_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a gauge's flood class between readings that follow each other."""
    band = lambda c: flood_priority(F.col(c), F.col("minor"), F.col("moderate"), F.col("major"))
    rows = previous(spark, sf_dir).where("prev_height IS NOT NULL").withColumns({"now": band("height"), "before": band("prev_height")}).where("now <> before")
    rising = F.col("now") < F.col("before")
    severity = F.when(~rising, 0).when(F.col("now") == 1, 3).otherwise(2)
    return rows.select("station", "ts", "before", "now", F.when(rising, "threshold").otherwise("receding").alias("kind"), severity.alias("severity"))


@query(""", s AS (SELECT station, ts, seq, CASE WHEN height >= 120 THEN 'strong' WHEN height >= 60 THEN 'moderate' ELSE 'weak' END AS class FROM obs),
l AS (SELECT *, lag(class) OVER (PARTITION BY station ORDER BY ts, seq) AS before FROM s)
SELECT station, ts, before, class, CASE WHEN class = 'strong' THEN 3 WHEN class = 'moderate' AND before = 'weak' THEN 2 ELSE 0 END AS severity FROM l
WHERE before <> class AND (class = 'strong' OR before = 'strong' OR before = 'weak')""")
def storm_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensification, and weakening only out of strong."""
    kind = F.when(F.col("height") >= 120, "strong").when(F.col("height") >= 60, "moderate").otherwise("weak")
    rows = temporal.with_previous(observations(spark, sf_dir).withColumn("class", kind), ["station"], "ts", "seq", ["class"])
    rows = rows.withColumnRenamed("prev_class", "before").where("before <> class AND (class = 'strong' OR before = 'strong' OR before = 'weak')")
    severity = F.when(F.col("class") == "strong", 3).when((F.col("class") == "moderate") & (F.col("before") == "weak"), 2).otherwise(0)
    return rows.select("station", "ts", "before", "class", severity.alias("severity"))


@query("SELECT station, ts, seq, round(height - prev_height, 6) AS step FROM prev")
def step_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous(spark, sf_dir).select("station", "ts", "seq", F.round(F.col("height") - F.col("prev_height"), 6).alias("step"))


RISES = ", rises AS (SELECT station, ts, seq FROM prev WHERE height - prev_height >= 20 AND height >= 0.9 * minor)"


def _rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous(spark, sf_dir).where("height - prev_height >= 20 AND height >= 0.9 * minor").select("station", "ts", "seq")


@query(RISES + """, shown(station, ts) AS (SELECT station, min(ts) FROM rises GROUP BY station
UNION ALL SELECT s.station, (SELECT min(r.ts) FROM rises r WHERE r.station = s.station AND r.ts > s.ts + INTERVAL 12 HOUR) FROM shown s WHERE s.ts IS NOT NULL)
SELECT r.station, r.ts, min(r.seq) AS seq FROM rises r JOIN shown s ON r.station = s.station AND r.ts = s.ts GROUP BY r.station, r.ts""", recursive=True)
def fast_rise_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fast rises near flood level, none within 12 hours after another of its gauge that was shown."""
    return folds.spaced(_rises(spark, sf_dir), ["station"], "ts", "seq", 720)


@query(RISES + """, stored AS (SELECT station, ts FROM obs WHERE catchment = 'signup' AND height >= 60),
open AS (SELECT * FROM rises r WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station = r.station AND s.ts <= r.ts AND s.ts >= r.ts - INTERVAL 12 HOUR)),
shown(station, ts) AS (SELECT station, min(ts) FROM open GROUP BY station
UNION ALL SELECT s.station, (SELECT min(r.ts) FROM open r WHERE r.station = s.station AND r.ts > s.ts + INTERVAL 12 HOUR) FROM shown s WHERE s.ts IS NOT NULL)
SELECT r.station, r.ts, min(r.seq) AS seq FROM open r JOIN shown s ON r.station = s.station AND r.ts = s.ts GROUP BY r.station, r.ts""", recursive=True)
def fast_rise_against_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where entries stored before hold back rises of the 12 hours after them."""
    stored = observations(spark, sf_dir).where("catchment = 'signup' AND height >= 60").select("station", "ts")
    return folds.spaced(_rises(spark, sf_dir), ["station"], "ts", "seq", 720, stored)


@query(""", d AS (SELECT date_trunc('hour', ts) AS hour, round(sum(height), 4) AS customers FROM obs GROUP BY 1),
p AS (SELECT a.hour, a.customers, b.customers AS before FROM d a JOIN d b ON b.hour = a.hour - INTERVAL 1 HOUR)
SELECT hour, customers, before, round(100 * (customers - before) / before, 4) AS pct FROM p WHERE abs(customers - before) >= 200 AND abs(100 * (customers - before) / before) >= 25""")
def statewide_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours whose total differs much, and by a large share, from that of the hour before."""
    d = observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.round(F.sum("height"), 4).alias("customers"))
    before = d.select((F.col("hour") + F.expr("INTERVAL 1 HOUR")).alias("hour"), F.col("customers").alias("before"))
    pct = 100 * F.try_divide(F.col("customers") - F.col("before"), F.col("before"))
    rows = d.join(before, "hour").where((F.abs(F.col("customers") - F.col("before")) >= 200) & (F.abs(pct) >= 25))
    return rows.select("hour", "customers", "before", F.round(pct, 4).alias("pct"))


@query(""", m AS (SELECT catchment, station, ts, seq, CAST(floor(height / 50) AS BIGINT) AS label FROM obs),
l AS (SELECT *, lag(label) OVER (PARTITION BY catchment, station ORDER BY ts, seq) AS before, lag(seq) OVER (PARTITION BY catchment, station ORDER BY ts, seq) AS q FROM m)
SELECT catchment, station, ts, seq, label, before FROM l WHERE q IS NULL OR label IS DISTINCT FROM before""")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric's history with only its changes."""
    rows = observations(spark, sf_dir).select("catchment", "station", "ts", "seq", F.floor(F.col("height") / 50).alias("label"))
    out = changes.journal_rows(rows, ["catchment", "station"], "ts", "seq", "label")
    return out.select("catchment", "station", "ts", "seq", "label", F.col("prev_label").alias("before"))


@query("SELECT station, ts, prev_ts AS below_ts, height FROM prev WHERE prev_height < minor AND height >= minor AND ts BETWEEN TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'")
def crossing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When gauges crossed their minor level upwards, and when they were last below it."""
    rows = previous(spark, sf_dir).where("prev_height < minor AND height >= minor").where(F.col("ts").between(at("2024-01-13 00:00:00"), as_of()))
    return rows.select("station", "ts", F.col("prev_ts").alias("below_ts"), "height")


SPIKES = """, r AS (SELECT station, ts, seq, height * 10 AS h, row_number() OVER (PARTITION BY station ORDER BY ts, seq) AS k FROM obs WHERE height IS NOT NULL),
walk(station, k, last, ok) AS (SELECT station, 0, CAST({start} AS DOUBLE), false FROM r WHERE k = 1
UNION ALL SELECT r.station, CAST(r.k AS INTEGER), CASE WHEN (CASE WHEN w.last IS NULL THEN r.h <= 900 ELSE abs(r.h - w.last) <= 300 END) AND r.h <= 900 THEN r.h ELSE w.last END, CASE WHEN w.last IS NULL THEN r.h <= 900 ELSE abs(r.h - w.last) <= 300 END FROM walk w JOIN r ON r.station = w.station AND r.k = w.k + 1)
SELECT r.station, r.ts, r.seq, r.h AS height FROM r JOIN walk w ON r.station = w.station AND r.k = w.k WHERE ok UNION ALL SELECT station, ts, seq, height FROM obs WHERE height IS NULL"""


@query(SPIKES.format(start="NULL"), recursive=True)
def spike_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without those that jump by more than 300 from the last one accepted, or are over 900 before any is."""
    rows = observations(spark, sf_dir).select("station", "ts", "seq", (F.col("height") * 10).alias("height"))
    return folds.accepted(rows, ["station"], ["ts", "seq"], "height", F.to_date("ts"), jump=300.0)


@query(SPIKES.format(start="CASE WHEN station % 2 = 0 THEN 800 END"), recursive=True)
def spike_guard_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every second gauge has a stored height to begin with."""
    rows = observations(spark, sf_dir).select("station", "ts", "seq", (F.col("height") * 10).alias("height"))
    known = rows.where("station % 2 = 0").select("station", F.lit(800.0).alias("height")).distinct()
    return folds.accepted(rows, ["station"], ["ts", "seq"], "height", F.to_date("ts"), jump=300.0, baseline=known)


@query("SELECT station, height FROM latest WHERE height >= 0.9 * minor")
def near_flood_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_classed(spark, sf_dir).where("height >= 0.9 * minor").select("station", "height")


@query(""", k AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM obs GROUP BY 1),
t(instant) AS (VALUES (TIMESTAMP '2023-12-31 00:00:00'), (TIMESTAMP '2024-01-02 03:30:00'), (TIMESTAMP '2024-01-15 12:00:00'), (TIMESTAMP '2024-02-20 00:00:00'))
SELECT instant, (SELECT arg_max(hour, hour) FROM k WHERE hour <= instant AND hour >= instant - INTERVAL 6 HOUR) AS hour, (SELECT arg_max(n, hour) FROM k WHERE hour <= instant AND hour >= instant - INTERVAL 6 HOUR) AS n FROM t""")
def kpi_asof_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hourly figure as it stood at some times; unknown where it is over six hours old."""
    k = observations(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    times = instants(spark, ["2023-12-31 00:00:00", "2024-01-02 03:30:00", "2024-01-15 12:00:00", "2024-02-20 00:00:00"], "instant")
    return temporal.asof_series(times, k, at="instant", ts="hour")


TREND_SQL = """, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, ts ORDER BY seq DESC) AS j FROM obs WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00') WHERE j = 1),
x AS (SELECT *, epoch(ts - min(ts) OVER (PARTITION BY station)) / 3600 AS h, row_number() OVER (PARTITION BY station ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY station) // 2 AS mid FROM t),
f AS (SELECT station, count(*) AS n, max(h) AS span_h, regr_slope(height, h) AS rate, regr_sxx(height, h) AS sxx, regr_sxy(height, h) AS sxy, regr_syy(height, h) AS syy,
  regr_slope(height, h) FILTER (k <= mid) AS earlier, regr_slope(height, h) FILTER (k >= mid) AS recent, arg_max(height, ts) AS current FROM x GROUP BY station),
g AS (SELECT *, CASE WHEN n >= 3 AND sxx > 0 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) END AS stderr FROM f WHERE n >= 4 AND span_h >= 0.5),
a AS (SELECT *, (recent - earlier) / greatest(span_h / 2, 1e-6) AS accel, greatest(0.01, coalesce(stderr, 0)) AS eps, 40 + station % 20 + 100 AS target FROM g)
"""


def _fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("ts") > at("2024-01-15 00:00:00")) & (F.col("ts") <= as_of()))
    return trend.analyse(trend.fits(rows.select("station", "ts", "seq", "height"), "station"), 40 + F.col("station") % 20 + 100, horizon_h=240.0)


@query(TREND_SQL + "SELECT station, n, round(span_h, 5) AS span_h, round(rate, 6) AS rate, round(stderr, 6) AS stderr FROM a")
def trend_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).select("station", "n", *[F.round(c, p).alias(c) for c, p in (("span_h", 5), ("rate", 6), ("stderr", 6))])


@query(TREND_SQL + """SELECT station, round(earlier, 5) AS earlier, round(recent, 5) AS recent,
CASE WHEN recent - earlier IS NULL THEN 'Unknown' WHEN recent - earlier > eps THEN 'Increasing' WHEN recent - earlier < -eps THEN 'Decreasing' ELSE 'Steady' END AS accel_label,
CASE WHEN rate <= -0.02 THEN 'Falling' WHEN rate < 0.02 THEN 'Steady' WHEN rate >= 0.25 THEN 'Rising rapidly' WHEN recent - earlier > eps THEN 'Rising, accelerating' ELSE 'Rising' END AS headline FROM a""")
def trend_accel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fitted(spark, sf_dir).select("station", F.round("earlier", 5).alias("earlier"), F.round("recent", 5).alias("recent"), "accel_label", "headline")


@query(TREND_SQL + """, e AS (SELECT *, target - current AS d FROM a WHERE rate >= 0.02 AND target > current AND (target - current) / rate <= 240),
c AS (SELECT *, d / rate AS t, CASE WHEN stderr > 0 THEN d / (rate + stderr) END AS fast, CASE WHEN stderr > 0 THEN CASE WHEN rate - stderr > 0.02 THEN d / (rate - stderr) ELSE 240 END END AS slow, CASE WHEN accel > 0 THEN (-rate + sqrt(rate * rate + 2 * accel * d)) / accel END AS bent FROM e)
SELECT station, round(t, 3) AS eta_point, round(greatest(least(t, fast, slow, bent, t * 0.8), 1 / 60), 3) AS eta_early, round(least(greatest(t, fast, slow, bent, t * 1.2), 240), 3) AS eta_late FROM c""")
def trend_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours until gauges reach the next level, as a point and a band."""
    rows = _fitted(spark, sf_dir).where("eta_point IS NOT NULL")
    return rows.select("station", *[F.round(c, 3).alias(c) for c in ("eta_point", "eta_early", "eta_late")])


VERIFY_SQL = """, p AS (SELECT seq AS id, station, ts AS observed_at, height AS current, height * 1.5 AS target, ts + INTERVAL 6 HOUR AS eta_early, ts + INTERVAL 12 HOUR AS eta_point, ts + INTERVAL 48 HOUR AS eta_late,
  (seq % 5) * 60 AS lead FROM obs WHERE seq % 3 = 0 AND height >= minor AND ts <= TIMESTAMP '2024-01-20 00:00:00'),
s AS (SELECT * FROM obs WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'),
h AS (SELECT id, min(s.ts) AS hit FROM p JOIN s USING (station) WHERE s.ts > observed_at AND s.height >= target GROUP BY id),
v AS (SELECT p.*, hit, CASE WHEN hit IS NOT NULL THEN 'reached' WHEN TIMESTAMP '2024-01-20 00:00:00' >= eta_late + INTERVAL 3 HOUR AND l.ts > observed_at AND l.height < current THEN 'receded' WHEN TIMESTAMP '2024-01-20 00:00:00' >= eta_late + INTERVAL 3 HOUR THEN 'not_reached' END AS outcome
  FROM p LEFT JOIN h USING (id) LEFT JOIN latest l USING (station)),
r AS (SELECT id, station, lead, outcome, hit AS actual_ts, epoch_us(hit) / 60e6 - epoch_us(eta_point) / 60e6 AS error_minutes, CASE WHEN hit IS NOT NULL THEN CAST(hit BETWEEN eta_early AND eta_late AS INT) WHEN outcome IS NOT NULL THEN 0 END AS within_range FROM v)
"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections from a third of the readings in flood, each a rise by half, and how they turned out."""
    obs = observations(spark, sf_dir)
    p = obs.where((F.col("seq") % 3 == 0) & (F.col("height") >= F.col("minor")) & (F.col("ts") <= as_of()))
    after = lambda hours: F.col("ts") + F.expr(f"INTERVAL {hours} HOURS")
    p = p.select(F.col("seq").alias("id"), "station", F.col("ts").alias("observed_at"), F.col("height").alias("current"), (F.col("height") * 1.5).alias("target"), after(6).alias("eta_early"), after(12).alias("eta_point"), after(48).alias("eta_late"), ((F.col("seq") % 5) * 60).alias("lead"))
    return trend.verify(p, obs, as_of())


@query(VERIFY_SQL + "SELECT id, station, outcome, actual_ts, round(error_minutes, 3) AS error_minutes, within_range FROM r")
def first_hit_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verified(spark, sf_dir).select("id", "station", "outcome", "actual_ts", F.round("error_minutes", 3).alias("error_minutes"), "within_range")


ACCURACY = "count(*) AS total, CAST(sum(CASE WHEN outcome = 'reached' THEN 1 ELSE 0 END) AS BIGINT) AS reached, round(avg(CASE WHEN outcome = 'reached' THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(within_range, 0)), 6) AS within_range_rate, round(median(error_minutes), 3) AS median_error, round(median(abs(error_minutes)), 3) AS median_abs_error"


def _accuracy(df: DataFrame, keys: list[str]) -> DataFrame:
    out = trend.accuracy(df, keys)
    return out.select(*keys, "total", "reached", *[F.round(c, p).alias(c) for c, p in (("hit_rate", 6), ("within_range_rate", 6), ("median_error", 3), ("median_abs_error", 3))])


@query(VERIFY_SQL + f"SELECT {ACCURACY} FROM r WHERE outcome IS NOT NULL")
def accuracy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(_verified(spark, sf_dir), [])


@query(VERIFY_SQL + f"SELECT CASE WHEN lead < 60 THEN '0-60' WHEN lead < 180 THEN '60-180' WHEN lead < 360 THEN '180-360' ELSE '360+' END AS bucket, {ACCURACY} FROM r WHERE outcome IS NOT NULL GROUP BY 1")
def accuracy_by_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(_verified(spark, sf_dir).withColumn("bucket", lead_bucket(F.col("lead"))), ["bucket"])


@query(VERIFY_SQL + f"SELECT station AS target_name, {ACCURACY} FROM r WHERE outcome IS NOT NULL GROUP BY 1")
def accuracy_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(_verified(spark, sf_dir).withColumnRenamed("station", "target_name"), ["target_name"])


@query(""", stored AS (SELECT DISTINCT station, CAST(ts AS DATE) AS day FROM obs WHERE seq % 2 = 0 AND height >= 30)
SELECT station, ts, height, seq FROM (SELECT *, row_number() OVER (PARTITION BY station, CAST(ts AS DATE) ORDER BY seq) AS k FROM obs o WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.station = o.station AND s.day = CAST(o.ts AS DATE))) WHERE k = 1""")
def dedup_first_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch adds if a gauge's first reading of a day wins and some are stored already."""
    rows = observations(spark, sf_dir).select("station", "ts", "height", "seq", F.to_date("ts").alias("day"))
    stored, batch = rows.where("seq % 2 = 0 AND height >= 30"), rows.where("seq % 2 = 1")
    return changes.new_rows(stored, batch, ["station", "day"], "seq").select("station", "ts", "height", "seq")


@query(""", w(label, since) AS (VALUES ('1h', TIMESTAMP '2024-01-19 23:00:00'), ('6h', TIMESTAMP '2024-01-19 18:00:00'), ('24h', TIMESTAMP '2024-01-19 00:00:00'), ('7d', TIMESTAMP '2024-01-13 00:00:00'))
SELECT label, max(height) AS peak, arg_max(ts, (height, ts)) AS peak_ts FROM w JOIN obs ON ts >= since AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY label""")
def power_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peak within each of four spans, in one pass."""
    rows = observations(spark, sf_dir).where((F.col("ts") <= as_of()) & (F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")))
    spans = {"1h": "1 HOUR", "6h": "6 HOURS", "24h": "24 HOURS", "7d": "7 DAYS"}
    labels = F.array_compact(F.array(*[F.when(F.col("ts") >= as_of() - F.expr(f"INTERVAL {v}"), k) for k, v in spans.items()]))
    return rows.withColumn("label", F.explode(labels)).groupBy("label").agg(F.max("height").alias("peak"), F.max_by("ts", F.struct("height", "ts")).alias("peak_ts"))


@query("SELECT catchment, CAST(ts AS DATE) AS day, median(height) AS median_height, count(*) AS n FROM obs GROUP BY ALL")
def daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("catchment", F.to_date("ts").alias("day")).agg(F.median("height").alias("median_height"), F.count("*").alias("n"))


@query(""", e AS (SELECT station, ts, seq, height, CASE WHEN height >= major THEN 3 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 1 ELSE 0 END AS severity FROM obs WHERE ts > TIMESTAMP '2024-01-19 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT station, ts, seq, severity FROM e WHERE severity >= 1 ORDER BY severity DESC, ts DESC, seq LIMIT 120""")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).where("severity >= 1").orderBy(F.desc("severity"), F.desc("ts"), "seq").limit(120)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("ts") > as_of() - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") <= as_of()))
    return rows.select("station", "ts", "seq", (4 - flood_priority(F.col("height"), F.col("minor"), F.col("moderate"), F.col("major"))).alias("severity"))


@query("""SELECT s.severity, count(e.seq) AS n FROM (VALUES (3), (2), (1), (0)) s(severity)
LEFT JOIN (SELECT seq, CASE WHEN height >= major THEN 3 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 1 ELSE 0 END AS severity FROM obs WHERE ts > TIMESTAMP '2024-01-19 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00') e ON e.severity = s.severity GROUP BY s.severity""")
def severity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = spark.createDataFrame([(k,) for k in (3, 2, 1, 0)], "severity int")
    counted = _entries(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    return levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""SELECT catchment AS source, max(ts) AS last_ts, CASE WHEN max(ts) IS NULL THEN 'never' WHEN epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(max(ts)) > 30 * 60000000 THEN 'stale' ELSE 'ok' END AS state FROM obs WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY catchment""")
def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.functions.classify import source_state

    rows = observations(spark, sf_dir).where(F.col("ts") <= as_of()).groupBy(F.col("catchment").alias("source")).agg(F.max("ts").alias("last_ts"))
    age = F.timestamp_diff("MICROSECOND", F.col("last_ts"), as_of()) / F.lit(60e6)
    return rows.select("source", "last_ts", source_state(age, F.lit(10)).alias("state"))


@query("""SELECT * FROM (SELECT ts, 'gauge ' || station AS item, 0 AS pinned FROM obs WHERE catchment = 'error' AND ts > TIMESTAMP '2024-01-19 22:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'
UNION ALL SELECT ts, 'warning ' || station, 1 FROM obs WHERE catchment = 'signup' AND ts > TIMESTAMP '2024-01-19 22:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00')""")
def ticker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where((F.col("ts") > as_of() - F.expr("INTERVAL 2 HOURS")) & (F.col("ts") <= as_of()))
    item = lambda word: F.concat(F.lit(word), F.col("station").cast("string")).alias("item")
    a = rows.where("catchment = 'error'").select("ts", item("gauge "), F.lit(0).alias("pinned"))
    return a.unionByName(rows.where("catchment = 'signup'").select("ts", item("warning "), F.lit(1).alias("pinned"))).orderBy(F.desc("pinned"), F.desc_nulls_last("ts"))


@query("SELECT catchment, station, k FROM (SELECT catchment, station, ts, seq, row_number() OVER (PARTITION BY catchment ORDER BY ts DESC, seq DESC) AS k FROM latest) WHERE k <= 5")
def latest_five_by_catchment(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("catchment").orderBy(F.desc("ts"), F.desc("seq"))
    return latest_classed(spark, sf_dir).select("catchment", "station", F.row_number().over(order).alias("k")).where("k <= 5")


#: Impacts of guides, of parts; the next target of each gauge's latest height.
IMPACTS = """, im AS (SELECT p_partkey % 150 AS station, p_size * 6.0 AS height_m, p_name || ' ' || p_type AS impact FROM part),
nt AS (SELECT c.station, c.height AS current, minor, moderate, major, (SELECT arg_min(height_m, (height_m, impact)) FROM im WHERE im.station = c.station AND height_m > c.height) AS ih, (SELECT arg_min(impact, (height_m, impact)) FROM im WHERE im.station = c.station AND height_m > c.height) AS iname FROM classed c)
"""


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 150).alias("station"), (F.col("p_size") * 6.0).alias("height_m"), F.concat_ws(" ", "p_name", "p_type").alias("impact"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("station", "minor", "moderate", "major").distinct()


@query(IMPACTS + """SELECT station, current, CASE WHEN current < major THEN 'class' WHEN ih IS NOT NULL THEN 'impact' END AS target_kind, CASE WHEN current < minor THEN 'minor' WHEN current < moderate THEN 'moderate' WHEN current < major THEN 'major' ELSE iname END AS target_name,
CAST(CASE WHEN current < minor THEN minor WHEN current < moderate THEN moderate WHEN current < major THEN major ELSE ih END AS DOUBLE) AS target FROM nt""")
def next_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gauge comes to next: a flood class, or an impact that a guide knows of."""
    rows = latest_classed(spark, sf_dir).select("station", F.col("height").alias("current"))
    return trend.next_target(rows, _levels(spark, sf_dir), _impacts(spark, sf_dir))


@query(IMPACTS + """SELECT im.station, height_m, impact, CASE WHEN height_m >= major THEN 1 WHEN height_m >= moderate THEN 2 WHEN height_m >= minor THEN 3 ELSE 4 END AS priority, coalesce(current >= height_m, false) AS reached FROM im JOIN nt USING (station)""")
def impacts_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts of gauges with readings, their class, and whether the water is there."""
    rows = latest_classed(spark, sf_dir).select("station", F.col("height").alias("current"))
    known = _impacts(spark, sf_dir).join(rows.select("station"), "station", "left_semi")
    return trend.impact_table(known, rows, _levels(spark, sf_dir))


#: Analyses at fourteen polls of the readings of five days before each.
POLLED = IMPACTS + """, pl(poll) AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-06 00:00:00', TIMESTAMP '2024-01-19 00:00:00', INTERVAL 1 DAY))),
pt AS (SELECT * FROM (SELECT poll, obs.*, row_number() OVER (PARTITION BY poll, station, ts ORDER BY seq DESC) AS j FROM pl JOIN obs ON ts > poll - INTERVAL 5 DAY AND ts <= poll) WHERE j = 1),
px AS (SELECT *, epoch(ts - min(ts) OVER (PARTITION BY poll, station)) / 3600 AS h, row_number() OVER (PARTITION BY poll, station ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY poll, station) // 2 AS mid FROM pt),
pf AS (SELECT poll, station, any_value(minor) AS minor, any_value(moderate) AS moderate, any_value(major) AS major, count(*) AS n, max(h) AS span_h, regr_slope(height, h) AS rate, regr_sxx(height, h) AS sxx, regr_sxy(height, h) AS sxy, regr_syy(height, h) AS syy,
  regr_slope(height, h) FILTER (k <= mid) AS earlier, regr_slope(height, h) FILTER (k >= mid) AS recent, arg_max(height, ts) AS current, max(ts) AS observed_at FROM px GROUP BY poll, station),
pg AS (SELECT *, CASE WHEN n >= 3 AND sxx > 0 THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) END AS stderr, (SELECT min(height_m) FROM im WHERE im.station = pf.station AND height_m > pf.current) AS ih FROM pf),
pa AS (SELECT *, (recent - earlier) / greatest(span_h / 2, 1e-6) AS accel, CASE WHEN current < minor THEN minor WHEN current < moderate THEN moderate WHEN current < major THEN major ELSE ih END AS target FROM pg),
pr AS (SELECT *, CASE WHEN n < 4 OR span_h < 0.5 THEN 'few' WHEN target IS NULL THEN 'above' WHEN rate IS NULL OR rate < 0.02 THEN 'slow' WHEN (target - current) / rate > 240 THEN 'far' ELSE 'due' END AS why FROM pa),
pe AS (SELECT *, (target - current) / rate AS t, (target - current) AS d FROM pr WHERE why = 'due'),
pc AS (SELECT *, CASE WHEN stderr > 0 THEN d / (rate + stderr) END AS fast, CASE WHEN stderr > 0 THEN CASE WHEN rate - stderr > 0.02 THEN d / (rate - stderr) ELSE 240 END END AS slow, CASE WHEN accel > 0 THEN (-rate + sqrt(rate * rate + 2 * accel * d)) / accel END AS bent FROM pe),
ph AS (SELECT *, greatest(least(t, fast, slow, bent, t * 0.8), 1 / 60) AS early, least(greatest(t, fast, slow, bent, t * 1.2), 240) AS late FROM pc),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station, target, observed_at ORDER BY poll) AS j FROM ph WHERE current >= 0.8 * minor) WHERE j = 1),
pj AS (SELECT *, observed_at + to_microseconds(CAST(round(t * 3.6e9) AS BIGINT)) AS eta_point, observed_at + to_microseconds(CAST(round(early * 3.6e9) AS BIGINT)) AS eta_early, observed_at + to_microseconds(CAST(round(late * 3.6e9) AS BIGINT)) AS eta_late FROM once),
pv AS (SELECT pj.*, (SELECT min(ts) FROM obs o WHERE o.station = pj.station AND o.ts > observed_at AND o.ts <= least(eta_late + INTERVAL 3 HOUR, TIMESTAMP '2024-01-20 00:00:00') AND o.height >= target) AS hit,
  (SELECT arg_max(height, (ts, seq)) FROM obs o WHERE o.station = pj.station AND o.ts > observed_at AND o.ts <= least(eta_late + INTERVAL 3 HOUR, TIMESTAMP '2024-01-20 00:00:00')) AS last FROM pj),
po AS (SELECT *, CASE WHEN hit IS NOT NULL THEN 'reached' WHEN TIMESTAMP '2024-01-20 00:00:00' >= eta_late + INTERVAL 3 HOUR THEN CASE WHEN last < current THEN 'receded' ELSE 'not_reached' END END AS outcome FROM pv)
"""


def _polled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of every gauge at every poll; their key is the gauge and the day of the poll."""
    days = F.explode(F.sequence(F.lit(6), F.lit(19)))
    rows = observations(spark, sf_dir).withColumn("day", days).withColumn("poll", at("2024-01-01 00:00:00") + F.make_dt_interval(days=F.col("day") - 1))
    rows = rows.where((F.col("ts") > F.col("poll") - F.expr("INTERVAL 5 DAYS")) & (F.col("ts") <= F.col("poll"))).withColumn("key", F.col("station") * 100 + F.col("day"))
    fitted = trend.fits(rows.select("key", "ts", "seq", "height"), "key")
    known = [df.withColumn("day", days).withColumn("key", F.col("station") * 100 + F.col("day")).drop("day", "station") for df in (_levels(spark, sf_dir), _impacts(spark, sf_dir))]
    out = trend.analysed(fitted, *known, key="key", window_minutes=7200, least=0.02, rapid=0.25, horizon_h=240.0, range_pct=20.0, min_n=4, min_span_h=0.5)
    return out.withColumns({"station": F.floor(F.col("key") / 100), "poll": at("2024-01-01 00:00:00") + F.make_dt_interval(days=(F.col("key") % 100 - 1).cast("int"))})


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of all polls, each gauge's for one target and reading once."""
    levels = _levels(spark, sf_dir).select("station", "minor")
    rows = trend.near_flood(_polled(spark, sf_dir).join(levels, "station").withColumn("height", F.col("current")), 0.8)
    made = trend.projections(rows, F.col("poll"))
    return changes.new_rows(made.limit(0), made, ["station", "target", "observed_at"], "made_at")


@query(POLLED + """SELECT station, poll, n, CAST(target AS DOUBLE) AS target, CASE why WHEN 'few' THEN 'Only ' || n || ' reading(s) in the last 7200 minutes — at least 4 spanning 30 minutes are needed.' WHEN 'above' THEN 'Already above every known threshold.' WHEN 'slow' THEN 'Not rising fast enough to project (rate below 0.02 m/hr).' WHEN 'far' THEN 'At the current rate the threshold is more than 240 hours away — too far out to project usefully.' END AS eta_reason FROM (SELECT * REPLACE (CASE WHEN why = 'few' THEN NULL ELSE target END AS target) FROM pr)""")
def trend_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gauge's own target at each poll, and why it has no arrival."""
    return _polled(spark, sf_dir).select("station", "poll", "n", "target", "eta_reason")


@query(POLLED + "SELECT station, poll AS made_at, observed_at, current, CAST(target AS DOUBLE) AS target, round(t, 3) AS hours, CAST(round_even(t * 60, 0) AS BIGINT) AS lead_minutes, outcome, hit AS actual_ts FROM po")
def projections_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections recorded at polls, and how each turned out when it fell due."""
    rows = trend.settle(_recorded(spark, sf_dir), observations(spark, sf_dir), as_of())
    hours = F.timestamp_diff("MICROSECOND", "observed_at", "eta_point") / F.lit(3.6e9)
    return rows.select("station", "made_at", "observed_at", "current", "target", F.round(hours, 3).alias("hours"), "lead_minutes", "outcome", "actual_ts")


@query(POLLED + "SELECT station, count(*) AS pending FROM po WHERE outcome IS NULL GROUP BY station")
def projections_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.pending_counts(trend.settle(_recorded(spark, sf_dir), observations(spark, sf_dir), as_of()))


@query(POLLED + "SELECT made_at, count(*) AS n FROM (SELECT poll AS made_at FROM po WHERE outcome IS NOT NULL ORDER BY poll DESC LIMIT 25) GROUP BY made_at")
def projections_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 projections that are settled, by poll."""
    rows = trend.recent(trend.settle(_recorded(spark, sf_dir), observations(spark, sf_dir), as_of()), verified_only=True)
    return rows.groupBy("made_at").agg(F.count("*").alias("n"))
