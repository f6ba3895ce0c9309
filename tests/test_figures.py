"""Figures of the situation where feeds are empty, null or tied."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.operators import figures, rainfall

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


POWER, GAUGES, FIRES, WEATHER, ROADS, CELLS, RAIN = f"ts {NTZ}, seq long, customers_off long", "priority int", "category1 string, feed_type string, warning_level string, resolved int", "type string, group_type string, active int", "is_closure int, resolved int", "classification string, intensity_score double", "station string, value double"


def situation(spark, *rows):
    tables = [spark.createDataFrame(r, s) for r, s in zip(rows, (POWER, GAUGES, FIRES, WEATHER, ROADS, CELLS, RAIN), strict=True)]
    return [(r.label, r.value, r.alert, r.detail) for r in figures.situation(*tables).orderBy("position").collect()]


def test_twelve_figures(spark):
    fires = [("Fire", "incident", None, 0), ("fire", None, None, 0), ("Tree", "incident", None, 0), ("Fire", "warning", " evacuate ", 0), ("Fire", "warning", "Watch and Act", 0), ("Fire", "warning", "Watch and Act", 1), ("Fire", "warning", None, 0)]
    got = situation(spark, [(at(0), 1, 30_000), (at(1), 2, 20_001), (at(1), 1, 5)], [(1,), (2,), (3,), (3,), (4,), (None,)], fires, [("flood", None, 1), (None, "Severe", 1), (None, None, 0)], [(1, 0), (0, 0), (None, 0), (1, 1)], [("strong", 1.0), ("moderate", 2.0), (None, None), ("weak", 9.0)], [("a", 5.0), ("b", 7.25), ("c", None)])
    assert [v for _, v, _, _ in got] == ["20,001", "4", "2", "1", "2", "1", "1", "2", "3", "1", "2", got[11][1]]
    assert [a for _, _, a, _ in got] == [True] * 8 + [False, True, True, False] and got[11][3] == "b"
    none = situation(spark, [], [], [], [], [], [], [])
    assert [v for _, v, _, _ in none] == ["—"] + ["0"] * 10 + ["—"] and not any(a for _, _, a, _ in none)


def test_counts(spark):
    rows = spark.createDataFrame([("severe_flood", "MAJOR", 1), ("flood", "minor", 1), (None, None, 1), ("severe", "severe", 0)], WEATHER)
    assert tuple(figures.warning_counts(rows).first()) == (3, 2, 1, 1)
    assert tuple(figures.storm_counts(spark.createDataFrame([("strong", 7.9), (None, None)], CELLS)).first()) == (2, 1, 0, 7)
    assert tuple(figures.storm_counts(spark.createDataFrame([], CELLS)).first()) == (0, 0, 0, 0)
    series = spark.createDataFrame([(3, None, 2, 4), (None, 1, None, 9), (None, None, None, None)], "emergency_warnings int, watch_act int, advice int, total_active int")
    assert [(r.warnings_total, r.incidents_total) for r in figures.fire_totals(series).collect()] == [(5, 0), (1, 8), (0, 0)]


def test_history_of_the_strongest_cells(spark):
    rows = [("a", at(0), 5.0), ("a", at(-99), 99.0), ("b", at(0), 7.0), ("b", at(1), None), ("c", at(0), None), ("d", at(0), 6.0)]
    df = spark.createDataFrame(rows, f"cell_id string, ts {NTZ}, intensity_score double")
    assert sorted((r.cell_id, r.ts) for r in figures.cell_history(df, F.lit(at(-10)).cast(NTZ), 2).collect()) == [("b", at(0)), ("b", at(1)), ("d", at(0))]


def test_peaks_count_back_from_the_last_time(spark):
    df = spark.createDataFrame([(at(0), 9.0), (at(30), 9.0), (at(100), 3.0), (at(120), None), (None, 99.0)], f"ts {NTZ}, v double")
    assert {tuple(r) for r in figures.peaks(df, "v", {"1h": "1 HOUR", "2h": "2 HOURS"}).collect()} == {("1h", 3.0, at(100)), ("2h", 9.0, at(0))}
    assert figures.peaks(df.limit(0), "v", {"1h": "1 HOUR"}).count() == 0


def test_metric_records(spark):
    rows = [(1.0, "x"), (1.0 + 1e-12, "x"), (1.0, "y"), (None, "y"), (None, "y"), (None, None), (2.0, None), (2.0, None)]
    df = spark.createDataFrame([("k", at(i), i, v, s) for i, (v, s) in enumerate(rows)], f"k string, ts {NTZ}, seq long, v double, s string")
    out = figures.metric_records(df, ["k"], "ts", "seq", "v", "s")
    assert sorted(r.seq for r in out.collect()) == [0, 2, 3, 5, 6] and "prev_v" in out.columns


def test_warnings_of_both_authorities(spark):
    fire = [(k, "warning", "Advice", None, None, None, f"A{k}", None, at(k), at(k), 0) for k in range(7)]
    fire += [(20, "warning", " Emergency Warning", "Evacuate", "c2", "c1", None, "H", at(0), None, 0), (21, "warning", "Community Information", None, None, None, "x", None, at(0), at(0), 0), (22, "incident", "Advice", None, None, None, "x", None, at(0), at(0), 0), (23, "warning", "Watch and Act", " ", None, "c1", " ", None, None, at(0), 0), (24, "warning", "Watch and Act", None, None, None, "over", None, at(0), at(0), 1)]
    incidents = spark.createDataFrame(fire, f"seq long, feed_type string, warning_level string, event string, category2 string, category1 string, location string, headline string, created {NTZ}, updated {NTZ}, resolved int")
    weather = spark.createDataFrame([(1, "flood_watch", "F", "minor", at(5), 1), (2, None, None, "Severe", at(1), 1), (3, "x", "gone", "Severe", at(1), 0)], f"seq long, type string, title string, group_type string, issue_time {NTZ}, active int")
    rows, omitted = figures.briefing_warnings(incidents, weather)
    assert [(r.source[0], r.kind, r.title) for r in rows.orderBy("position").collect()] == [("V", "Evacuate", "H"), ("V", "c1", "Warning"), *[("V", "Incident", f"A{k}") for k in (6, 5, 4, 3, 2)], ("B", "Warning", ""), ("B", "Flood Watch", "F")]
    assert omitted.first().omitted == 2
    assert figures.briefing_warnings(incidents.limit(0), weather.limit(0))[0].count() == 0


def test_weather_block_without_readings(spark):
    schema = "station string, gust double, humidity double, rain double, daily_gust double, daily_gust_time string"
    assert [r.value for r in figures.weather_block(spark.createDataFrame([], schema)).orderBy("position").collect()] == ["—"] * 4
    rows = [("b", 50.0, None, 0.0, 70.0, " "), ("a", 50.0, None, 0.25, 70.0, None), ("c", None, None, None, 60.0, "02:40pm")]
    assert [(r.value, r.detail) for r in figures.weather_block(spark.createDataFrame(rows, schema)).orderBy("position").collect()][::3] == [("50 km/h", "a"), ("70 km/h", "a")]


def test_rain_of_towns(spark):
    readings = spark.createDataFrame([("a", "A", at(0), 1.0), ("a", "A", at(5), None), ("a", "A", at(5), 2.0), ("b", "B", at(1), float("nan")), (None, "N", at(9), 9.0)], f"location_key string, name string, ts {NTZ}, rain double")
    places = spark.createDataFrame([("a", "River"), ("a", "River")], "location_key string, catchment string")
    latest = rainfall.latest_rainfall(readings, places)
    assert [(r.location_key, r.rain, r.catchment) for r in latest.collect()] == [("a", 2.0, "River"), ("a", None, "River"), ("b", None, None)]
    assert tuple(rainfall.summary(latest).first()) == (3, "A", 2.0)
    gauges = spark.createDataFrame([("Creek at A",), ("Creek upstream of B (D/S) HG",), ("Creek",), (None,)], "station_name string")
    assert [(r.station_name, r.catchment) for r in rainfall.location_of_gauge(gauges, places.distinct()).collect()] == [("Creek at A", "River")]
