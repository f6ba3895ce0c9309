"""Replay of an event: orders as journals of four sources, events as gauges, storm cells and weather stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.functions.times import at
from tidewatch.operators import intervals, replay
from tidewatch.plans.registry import as_of, observations, place, query, table

START = "2024-01-18 00:00:00"
#: Orders as a journal within the days of the events, with states as JSON that also name a column of the journal.
JOURNAL_SQL = """, jn AS (SELECT CASE left(o_orderpriority, 1) WHEN '1' THEN 'fire' WHEN '2' THEN 'roads' WHEN '3' THEN 'power' ELSE 'weather' END AS source, o_custkey AS entity_key, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(o_orderkey * 7 % 43200) AS effective_ts,
  CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS active, o_orderkey AS seq, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_custkey % 4 <> 0 THEN -39 + (o_custkey % 50) * CAST(0.1 AS DOUBLE) WHEN o_custkey % 8 = 0 THEN -30 END AS lat, CASE WHEN o_custkey % 4 <> 0 THEN 141 + (o_custkey % 80) * CAST(0.1 AS DOUBLE) WHEN o_custkey % 8 = 0 THEN 150 END AS lon FROM orders),
t(moment) AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-20 00:00:00', INTERVAL 6 HOUR))),
js AS (SELECT * FROM (SELECT t.moment, jn.*, row_number() OVER (PARTITION BY t.moment, source, entity_key ORDER BY effective_ts DESC, seq DESC) AS k FROM t JOIN jn ON effective_ts <= t.moment) WHERE k = 1 AND active = 1),
fl AS (SELECT * FROM (SELECT t.moment, o.*, row_number() OVER (PARTITION BY t.moment, station ORDER BY ts DESC, seq DESC) AS k FROM t JOIN obs o ON ts <= t.moment AND ts >= t.moment - INTERVAL 24 HOUR) WHERE k = 1),
gs AS (SELECT fl.*, CASE WHEN height >= major THEN 1 WHEN height >= moderate THEN 2 WHEN height >= minor THEN 3 ELSE 4 END AS priority, lat, lon FROM fl JOIN coords USING (station)),
cells AS (SELECT station % 40 AS cell_id, date_trunc('minute', ts) AS ts, seq, height FROM obs WHERE catchment = 'error'),
cs AS (SELECT t.moment, c.* FROM t JOIN cells c ON c.ts <= t.moment AND c.ts >= t.moment - INTERVAL 20 MINUTE WHERE c.ts = (SELECT max(d.ts) FROM cells d WHERE d.cell_id = c.cell_id AND d.ts <= t.moment)),
aws AS (SELECT station AS wmo, date_trunc('hour', ts) AS ts, seq, height FROM obs WHERE catchment <> 'error'),
ws AS (SELECT t.moment, a.*, lat, lon FROM t JOIN aws a ON a.ts <= t.moment AND a.ts >= t.moment - INTERVAL 24 HOUR JOIN (SELECT t.moment, wmo, max(ts) AS m FROM t JOIN aws ON ts <= t.moment GROUP BY ALL) b ON b.moment = t.moment AND b.wmo = a.wmo AND b.m = a.ts LEFT JOIN coords ON coords.station = a.wmo)
"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, entity_key, effective_ts, active, seq, latitude, longitude, state_json)."""
    o = table(spark, sf_dir, "orders")
    kind = F.left("o_orderpriority", F.lit(1))
    source = F.when(kind == "1", "fire").when(kind == "2", "roads").when(kind == "3", "power").otherwise("weather")
    lat, lon = place(F.col("o_custkey"))
    known = F.col("o_custkey") % 4 != 0
    state = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(0).alias("active")))
    return o.select(
        source.alias("source"), F.col("o_custkey").alias("entity_key"), (at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(F.col("o_orderkey") * 7 % 43200).cast("int"))).alias("effective_ts"),
        (F.col("o_orderstatus") != "F").cast("int").alias("active"), F.col("o_orderkey").alias("seq"), F.when(known, lat).alias("latitude"), F.when(known, lon).alias("longitude"), state.alias("state_json"),
    )


def _instants(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(times.marks(at(START), as_of())).alias("at"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.registry import coords

    return coords(spark, sf_dir).withColumnsRenamed({"lat": "latitude", "lon": "longitude"})


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.states_at(journal(spark, sf_dir), _instants(spark))
    cache = table(spark, sf_dir, "orders").where("o_custkey % 8 = 0").select(F.col("o_custkey").alias("location"), F.lit(-30.0).alias("latitude"), F.lit(150.0).alias("longitude")).distinct()
    return replay.expand_state(replay.filled(rows, cache), "status string, price double, active int")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FRAME rows of all seven layers at the marks of the event."""
    obs, when, places = observations(spark, sf_dir), _instants(spark), _places(spark, sf_dir)
    states = _states(spark, sf_dir)
    cells = obs.where("catchment = 'error'").select((F.col("station") % 40).alias("cell_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "seq", "height")
    aws = obs.where("catchment <> 'error'").select(F.col("station").alias("wmo"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "seq", "height")
    stations = replay.weather_at(aws, places.withColumnRenamed("station", "wmo"), when)
    return replay.frames([
        replay.frame(states, F.col("source"), "entity_key", F.col("status"), F.col("price")),
        replay.frame(replay.gauges_at(obs, places, when), "flood", "station", F.col("priority"), F.col("height")),
        replay.frame(replay.cells_at(cells, when).withColumns({"latitude": F.lit(None), "longitude": F.lit(None)}), "storm", "cell_id", F.lit("cell"), F.col("height")),
        replay.frame(stations.withColumn("layer", F.explode(F.array(F.lit("rain"), F.lit("wind")))), F.col("layer"), "wmo", F.col("layer"), F.col("height")),
    ])


@query(JOURNAL_SQL + """SELECT moment, source AS layer, CAST(entity_key AS VARCHAR) AS entity_key, status AS label, price AS value, round(lat, 6) AS latitude, round(lon, 6) AS longitude FROM js
UNION ALL SELECT moment, 'flood', CAST(station AS VARCHAR), CAST(priority AS VARCHAR), height, round(lat, 6), round(lon, 6) FROM gs
UNION ALL SELECT moment, 'storm', CAST(cell_id AS VARCHAR), 'cell', height, NULL, NULL FROM cs
UNION ALL SELECT moment, layer, CAST(wmo AS VARCHAR), layer, height, round(lat, 6), round(lon, 6) FROM ws, (VALUES ('rain'), ('wind')) l(layer)""")
def replay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer at each mark of an event's slider."""
    return layers(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("latitude", "longitude")}).withColumnRenamed("at", "moment")


@query(JOURNAL_SQL + """SELECT moment, (SELECT count(*) FROM js WHERE js.moment = t.moment AND source = 'fire') AS fires, (SELECT count(*) FROM js WHERE js.moment = t.moment AND source = 'roads') AS closures, (SELECT count(*) FROM js WHERE js.moment = t.moment AND source = 'power' AND lat IS NOT NULL) AS placed_outages,
(SELECT count(*) FROM gs WHERE gs.moment = t.moment AND priority <= 3) AS minor, (SELECT count(*) FROM gs WHERE gs.moment = t.moment AND priority <= 2) AS moderate, (SELECT count(*) FROM gs WHERE gs.moment = t.moment AND priority = 1) AS major, (SELECT count(*) FROM cs WHERE cs.moment = t.moment) AS cells FROM t""")
def replay_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each frame."""
    rows = layers(spark, sf_dir)
    on = lambda layer, more=F.lit(True): F.count_if((F.col("layer") == layer) & more)
    p = F.col("label").try_cast("int")
    counted = rows.groupBy("at").agg(on("fire").alias("fires"), on("roads").alias("closures"), on("power", F.col("latitude").isNotNull()).alias("placed_outages"), on("flood", p <= 3).alias("minor"), on("flood", p <= 2).alias("moderate"), on("flood", p == 1).alias("major"), on("storm").alias("cells"))
    return _instants(spark).join(counted, "at", "left").fillna(0).withColumnRenamed("at", "moment")


#: Suppliers as tags of events, some still going on, one for ever back.
TAGS_SQL = """, tg AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey = 0 THEN TIMESTAMP '1990-01-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey * 701 % 43200) END AS start_ts, CASE WHEN s_suppkey % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(s_suppkey * 701 % 43200) + to_minutes(CAST(s_acctbal AS BIGINT) % 3000) END AS end_ts FROM supplier),
tw AS (SELECT *, greatest(start_ts, coalesce(end_ts, TIMESTAMP '2024-01-20 00:00:00')) AS stop FROM tg)
"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    start = at("2024-01-01 00:00:00") + F.make_dt_interval(mins=(k * 701 % 43200).cast("int"))
    end = start + F.make_dt_interval(mins=(F.rint("s_acctbal").cast("long") % 3000).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k == 0, at("1990-01-01 00:00:00")).otherwise(start).alias("start_ts"), F.when(k % 3 != 0, end).alias("end_ts"))


@query(TAGS_SQL + "SELECT id, name, start_ts AS \"start\", stop AS \"end\", end_ts IS NULL AS ongoing, (epoch_us(stop) - epoch_us(start_ts)) / 6e7 AS minutes FROM tw")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.tag_window(tags(spark, sf_dir), as_of()).select("id", "name", "start", "end", "ongoing", "minutes")


@query(TAGS_SQL + "SELECT id AS tag_id, count(*) AS n, max(height) AS peak, arg_max(seq, (height, seq)) AS peak_seq FROM tw JOIN obs ON ts BETWEEN start_ts AND stop GROUP BY id")
def tagged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings by event, and the highest of each."""
    first = [F.count("*").alias("n"), F.max("height").alias("peak"), F.max(F.struct("height", "seq")).alias("top")]
    rows = intervals.tagged_totals(observations(spark, sf_dir), "ts", tags(spark, sf_dir), as_of(), first, [F.sum("n").alias("n"), F.max("peak").alias("peak"), F.max("top").alias("top")])
    return rows.select("tag_id", "n", "peak", F.col("top.seq").alias("peak_seq"))


@query(TAGS_SQL + JOURNAL_SQL + "SELECT id AS tag_id, jn.source, count(*) AS n, count(DISTINCT entity_key) AS entities FROM tw JOIN jn ON effective_ts BETWEEN start_ts AND stop GROUP BY ALL")
def tagged_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded changes by event and source."""
    return intervals.tagged_counts(journal(spark, sf_dir), "effective_ts", tags(spark, sf_dir), as_of(), ["source"], "entity_key")


@query(TAGS_SQL + """, ev AS (SELECT CASE WHEN station % 7 = 0 THEN 'live' WHEN station % 7 < 6 THEN 'Flood ' || station % 40 END AS event, ts FROM obs), own AS (SELECT 'Flood ' || id AS name FROM tg WHERE id % 5 = 1)
SELECT event AS name, min(ts) AS start_ts, max(ts) AS end_ts, 'Migrated from a named collection event.' AS notes FROM ev WHERE event <> 'live' AND event NOT IN (SELECT name FROM own) GROUP BY event""")
def migrated_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named collections as tags, but for those that have one."""
    s = F.col("station")
    named = observations(spark, sf_dir).select(F.when(s % 7 == 0, "live").when(s % 7 < 6, F.concat(F.lit("Flood "), (s % 40).cast("string"))).alias("event"), "ts")
    own = tags(spark, sf_dir).where("id % 5 = 1").select(F.concat(F.lit("Flood "), F.col("id").cast("string")).alias("name"))
    return intervals.tags_of_events(named, own)
