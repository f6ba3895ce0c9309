"""Messages between two looks, and the log of incidents."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import alerts

T0 = dt.datetime(2026, 8, 11, 12)


def rows(spark, *alerts_):
    return spark.createDataFrame(alerts_, "kind string, key string, priority int, label string")


def told(df):
    return {(r.kind, r.part): (r.n, r.text) for r in df.collect()}


def test_first_look(spark):
    many = [("roads", f"r{k}", 1, f"Road {k}") for k in range(7)]
    got = told(alerts.started(rows(spark, ("flood", "a", 3, "Minor"), ("flood", "b", 1, "Major"), ("fire", "x", 2, "Z"), ("fire", "y", 2, "A"), ("storm", "1", 2, "MODERATE"), ("storm", "2", 1, "STRONG"), *many)))
    assert got == {("flood", "started"): (2, "worst: Major"), ("fire", "started"): (2, "worst: A"), ("storm", "started"): (1, "STRONG"), ("roads", "started"): (7, "Road 0; Road 1; Road 2; Road 3; Road 4 (+2 more)")}
    assert told(alerts.started(rows(spark, ("storm", "1", 2, "MODERATE")))) == {}


def test_changes(spark):
    before = rows(spark, ("flood", "a", 3, "Minor"), ("flood", "b", 2, "Moderate"), ("flood", "c", 2, "Moderate"), ("flood", "d", 2, "Moderate"), ("weather", "w", 1, "W"), ("storm", "1", 1, "S"), ("storm", "2", 2, "M"), ("roads", "r", 1, "R"))
    fires = [("fire", f"f{k}", 3 - k % 2, f"F{k:02}") for k in range(12)]
    after = rows(spark, ("flood", "a", 1, "Major"), ("flood", "b", 3, "Minor"), ("flood", "e", 3, "Minor"), ("roads", "s", 1, "S"), *fires)
    got = told(alerts.changed(before, after))
    assert got == {
        ("flood", "escalated"): (2, "a: Major; e: Minor"), ("flood", "cleared"): (2, "c; d"), ("weather", "cleared"): (1, None), ("storm", "cleared"): (1, None), ("roads", "cleared"): (1, "R"), ("roads", "escalated"): (1, "S"),
        ("fire", "escalated"): (12, "F01; F03; F05; F07; F09; F11; F00; F02; F04; F06 (+2 more)"),
    }
    assert told(alerts.changed(after, after)) == {}


def test_labels(spark):
    fire = spark.createDataFrame([("1", "warning", None, " ", None, None), ("2", "incident", " FIRE ", None, "Ash", None), ("3", "incident", "Tree", None, "Ash", None), (None, "warning", None, "Advice", "X", None)], "source_id string, feed_type string, category1 string, warning_level string, location string, status string")
    assert {r.key: (r.priority, r.label) for r in alerts.fire(fire, ["Fire"]).collect()} == {"1": (5, "Warning — VIC"), "2": (4, " FIRE  at Ash (active)")}
    road = spark.createDataFrame([("1", None, "Ash", None, 1), ("2", "A1", "Ash", "Flood", 1), ("3", " ", None, None, 1), ("4", "A1", None, None, 0)], "source_id string, road_name string, location string, disruption_type string, is_closure int")
    assert {r.key: r.label for r in alerts.roads(road).collect()} == {"1": "Ash", "2": "A1 (Ash) — Flood", "3": "road"}
    cell = spark.createDataFrame([("1", None, "strong", 90.4, 12.0, None, 4.0), ("2", "IDR023", "weak", 1.0, 1.0, 1.0, 1.0)], "cell_id string, radar_id string, classification string, intensity_score double, area_km2 double, speed_kmh double, bearing_deg double")
    assert [tuple(r) for r in alerts.storm(cell).collect()] == [("storm", "1", 1, "STRONG cell 1 on radar (score 90, ~12 km²)")]


def test_power_levels(spark):
    pairs = [(None, 5), (None, 20_001), (5, 6), (5, 10_001), (10_001, 20_001), (20_001, 3), (5, None)]
    got = [r.m for r in spark.createDataFrame(pairs, "a long, b long").select(alerts.power(F.col("a"), F.col("b")).alias("m")).collect()]
    assert [None if m is None else m.split(" — ")[0] for m in got] == [None, "Monitor started", None, "Low alert", "High alert", "Power recovered to normal", None]


def test_incident_log(spark):
    data = [(str(k) if k else None, k, "incident", "Fire", None, T0 + dt.timedelta(minutes=k)) for k in range(16)] + [("w", 99, "warning", "Fire", "x", T0 + dt.timedelta(days=1)), ("b", 98, "burn-area", None, "x", T0 + dt.timedelta(days=1)), ("n", 97, "incident", None, "Ash", None)]
    df = spark.createDataFrame(data, "source_id string, seq long, feed_type string, category1 string, location string, first_seen timestamp_ntz")
    seen = spark.createDataFrame([("15",), ("3",)], "ident string")
    got = {r.ident: r.new for r in alerts.incident_log(df, seen).collect()}
    assert got == {str(k): k not in (15, 3) for k in range(2, 16)}
    assert {r.new for r in alerts.incident_log(df, None).collect()} == {False} and alerts.incident_log(df, None, 20).where("ident = '2026-08-11 12:00:00|None|Fire'").count() == 1
