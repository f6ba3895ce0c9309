"""Surroundings of places, entries with them, and places where hazards meet."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.operators import context

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"
#: Some 5.6 km for each 0.05 degrees of latitude.
NEAR, FAR = 0.05, 0.5


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def layers(spark):
    roads = spark.createDataFrame([(-37.0, 145.0, 1, 0), (-37.0, 145.0, 0, 0), (-37.0 - NEAR, 145.0, None, 0), (-37.0, 145.0, 1, 1), (None, 145.0, 1, 0), (-37.0 - FAR, 145.0, 1, 0)], "lat double, lon double, is_closure int, resolved int")
    outages = spark.createDataFrame([("A", 1200, 0), ("A", 34, 0), ("B", 5, 0), ("C", 7, 0), ("A", 9, 1)], "location string, customers_off int, restored int")
    cache = spark.createDataFrame([("A", -37.0, 145.0), ("B", None, None)], "location string, lat double, lon double")
    gauges = spark.createDataFrame([(-37.0, 145.0, 3), (-37.0, 145.0, 4)], "lat double, lon double, priority int")
    fires = spark.createDataFrame([("incident", None, 0), ("warning", "Advice", 0), ("warning", " watch and act", 0), ("warning", "Unknown", 0), ("burn-area", None, 0), (None, None, 0), ("warning", "Evacuate", 1)], "feed_type string, warning_level string, resolved int").selectExpr("-37.0D AS lat", "145.0D AS lon", "*")
    return context.standing(roads, context.placed(outages, cache), gauges, fires)


def test_surroundings(spark):
    points = spark.createDataFrame([(1, -37.0, 145.0), (2, -37.0 - FAR, 145.0), (3, None, 145.0), (4, 10.0, 10.0), (5, -37.0, 145.0)], "id long, lat double, lon double")
    rows = {r.id: tuple(r)[3:] for r in context.surroundings(points, layers(spark)).collect()}
    assert rows[1] == rows[5] == (3, 1, 2, 1234, 1, 4, 3, 2, "watch and act") and rows[2] == (1, 1, 0, 0, 0, 0, 0, None, None) and rows[3] == rows[4] == (0,) * 7 + (None, None)


def test_feed_says_what_stands_around(spark):
    names = f"id long, ts {NTZ}, hazard string, severity int, entity_name string, metric string, prev_value double, new_value double, prev_label string, new_label string, unit string, since {NTZ}, rate string, lat double, lon double"
    row = lambda i, t, hazard, metric, lat, severity=2: (i, at(t), hazard, severity, "Ash", metric, 1.0, 2.0, None, None, "m", at(0), " Rising ", lat, 145.0)
    rows = spark.createDataFrame([row(1, 1, "fire", "area_ha", -37.0), row(2, 2, "fire", "warning_level", -37.0), row(3, 3, "flood", "height_m", -37.0), row(4, 4, "power", "x", None), row(5, 5, "roads", "x", -37.0, 0), row(6, 99, "fire", "x", -37.0), row(7, 0, "fire", "area_ha", -37.0)], names)
    got = context.feed(rows, layers(spark), times.at(str(at(0))), times.at(str(at(10))), least=1, limit=5, context_limit=4).orderBy("position").collect()
    first = ["Ash: 1 → 2 m since 12:00", "Rising"] if got[0].lines[0].startswith("Ash: 1 →") else [got[0].lines[0], "Rising"]
    road, power, gauge, fire = "3 road disruptions (1 full closure) within 10 km", "2 power outages nearby — 1,234 customers off", "1 gauge at or above minor flood level within 10 km", "4 active incidents, 3 under warning within 10 km"
    assert [(r.position, r.id) for r in got] == [(0, 4), (1, 3), (2, 2), (3, 1), (4, 7)]
    assert [r.lines[2:] for r in got] == [[], [road, power, fire], [road, power, gauge], ["watch and act remains current", road, power, gauge], []]
    assert all(r.lines[:2] == first for r in got)
    assert context.feed(rows.limit(0), layers(spark), times.at(str(at(0))), times.at(str(at(10)))).count() == 0


CHANGE = f"event_id long, hazard string, severity int, ts {NTZ}, headline string, entity_name string"


def test_several_hazards_at_one_place_are_a_consequence(spark):
    changes = [(1, "flood", 2, at(1), "River rises", "Gauge"), (2, "roads", 2, at(2), "Road shut", None), (3, "power", 3, at(0), "Lights out", " "), (4, "roads", 2, at(3), "Road shut", "R"), (5, "fire", 3, at(9), "Far fire", "F"), (6, "fire", 2, at(8), "Far fire", "G"), (7, "fire", 1, at(9), "Small", "S"), (8, "fire", 2, at(7), "Nowhere", "N")]
    stored = [("flood", "River rises", 0, -37.0), ("flood", "River rises", 5, None), ("roads", "Road shut", 1, 10.0), ("roads", "Road shut", 2, -37.0 - NEAR), ("power", "Lights out", 1, -37.0), ("fire", "Far fire", 1, -30.0), ("fire", "Small", 1, -37.0)]
    known = spark.createDataFrame([(h, t, at(m), k, lat, None if lat is None else 145.0) for k, (h, t, m, lat) in enumerate(stored)], f"hazard string, headline string, ts {NTZ}, seq long, lat double, lon double")
    got = context.consequences(spark.createDataFrame(changes, CHANGE), known, layers(spark)).collect()
    assert [(r.position, r.title, r.hazard) for r in got] == [(0, "Lights out", "power")]
    assert got[0].lines == ["Lights out", "Road shut", "River rises", "3 road disruptions (1 full closure) within 10 km", "2 power outages nearby — 1,234 customers off", "1 gauge at or above minor flood level within 10 km", "4 active incidents, 3 under warning within 10 km"]


def test_six_places_at_most_the_gravest_first(spark):
    rows = [(10 * k + j, h, 2 + k % 2, at(k), f"{h} {k}", f"P{k}") for k in range(9) for j, h in enumerate(("flood", "roads"))]
    known = spark.createDataFrame([(h, t, at(0), i, -37.0 - (i // 10), 145.0) for i, h, _, _, t, _ in rows], f"hazard string, headline string, ts {NTZ}, seq long, lat double, lon double")
    got = context.consequences(spark.createDataFrame(rows, CHANGE), known, layers(spark).limit(0)).orderBy("position").collect()
    assert [r.title for r in got] == ["P7", "P5", "P3", "P1", "P8", "P6"] and got[0].lines == ["flood 7", "roads 7"]


def test_wettest_station_near_a_gauge(spark):
    gauges = spark.createDataFrame([("g", -37.0, 145.0), ("far", 0.0, 0.0)], "station string, lat double, lon double")
    stations = spark.createDataFrame([("a", -37.0, 145.0), ("b", -37.0 - NEAR, 145.0), ("c", -38.0, 145.0), ("d", -37.0, 145.0)], "wmo string, lat double, lon double")
    rain = {"a": [(-1441, 9.0), (-1440, 3.0), (-60, 5.0), (-30, 1.0), (10, 99.0)], "b": [(-100, 0.0), (-50, None), (-10, 3.0)], "c": [(-9, 0.0), (-5, 50.0)], "d": [(-5, 7.0)]}
    readings = spark.createDataFrame([(s, at(t), t + 2000, v) for s, xs in rain.items() for t, v in xs], f"wmo string, ts {NTZ}, seq long, rain double")
    instants = spark.createDataFrame([(at(0),), (at(-60),)], f"at {NTZ}")
    got = {((r["at"] - T0).total_seconds() / 60, r.station): (r.max_mm, r.wettest, r.stations) for r in context.catchment_rainfall(gauges, instants, stations, readings).collect()}
    assert got == {(0, "g"): (3.0, "a", 2), (-60, "g"): (5.0, "a", 1)}


def test_stations_of_one_place_are_taken_together(spark):
    """Totals that only the order of their sums tells apart are equal: the nearest station counts; 2,500 gauges and stations at a place are one pair."""
    n = 2500
    gauges = spark.range(n).select(F.col("id").alias("station"), F.lit(-37.0).alias("lat"), F.lit(145.0).alias("lon"))
    stations = spark.range(n).select(F.col("id").alias("wmo"), F.when(F.col("id") == 0, -37.0 - NEAR).otherwise(-37.0).alias("lat"), F.lit(145.0).alias("lon"))
    rain = [(0, -30, 0.0), (0, -20, 0.1), (0, -10, 0.1 + 0.2)] + [(k, t, v) for k in range(1, n) for t, v in ((-30, 0.0), (-10, 0.3))]
    readings = spark.createDataFrame([(w, at(t), t + 100, v) for w, t, v in rain], f"wmo long, ts {NTZ}, seq long, rain double")
    out = context.catchment_rainfall(gauges, spark.createDataFrame([(at(0),)], f"at {NTZ}"), stations, readings)
    row = out.groupBy("wettest", "stations").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in row] == [(1, n, n)]
