"""Read models and the smaller feeds on inline rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.operators import detect, views
from tidewatch.sources import feeds

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def now():
    return times.at(str(T0))


def test_unknown_is_not_zero(spark):
    series = spark.createDataFrame([(at(-30), 1, 1200), (at(-20), 2, 0), (at(-10), 3, None), (at(-900), 0, 7)], f"ts {NTZ}, seq long, n int")
    none = spark.createDataFrame([], "station string, ts timestamp_ntz, seq long, height double, minor double, moderate double, major double")
    rows = views.historical_kpis([("Null", series, "n"), ("Zero", series.where("n = 0"), "n"), ("Old", series.where("n = 7"), "n"), ("Many", series.where("seq = 1"), "n")], none, now()).collect()
    assert [(r.label, r.value) for r in rows] == [("Null", "—"), ("Zero", "0"), ("Old", "—"), ("Many", "1,200"), ("Gauges ≥ Minor", "0")]


def test_ticker_pins_emergencies_and_drops_what_is_old(spark):
    weather = spark.createDataFrame([("Flood", "the Standard Emergency Warning Signal is used", at(-900), 1), ("Old", None, at(-900), 1), ("New", None, at(-2), 1), ("Gone", None, at(-1), 0), (None, None, None, 1)], f"title string, message string, first_seen {NTZ}, active int")
    warnings = spark.createDataFrame([("Evacuate", "A", "Fire", at(-500), 0), ("Advice", "B", None, at(-3), 0), ("Advice", "C", None, at(-3), 1)], f"warning_level string, location string, event string, first_seen {NTZ}, resolved int")
    heights = [("g", at(-30), 1, 1.0), ("g", at(-4), 2, 2.5), ("g", at(-1), 3, 2.6), ("h", at(-3), 4, 9.0), ("i", at(-90), 5, 1.0), ("i", at(-60), 6, 2.5)]
    readings = spark.createDataFrame([(*h, 2.0, 3.0, 4.0) for h in heights], f"station string, ts {NTZ}, seq long, height double, minor double, moderate double, major double")
    rows = views.ticker(weather, warnings, readings, now()).collect()
    assert [(r.item, r.emergency) for r in rows] == [("New", False), ("Advice — B", False), ("g — Minor flooding", False), ("Evacuate — A (Fire)", True), ("SEWS — Flood", True)]


def test_changes_and_timeline(spark):
    rows = [(k % 4, "e", f"k{k}", at(-k)) for k in range(10)] + [(3, "e", "late", at(5)), (None, "e", "none", at(-1))]
    entries = spark.createDataFrame(rows, f"severity int, entity_key string, kind string, ts {NTZ}")
    window = (now() - F.expr("INTERVAL 6 MINUTES"), now())
    assert [r.kind for r in views.significant(entries, *window).collect()] == ["k3", "k2", "k6", "k1", "k5"]
    assert [r.kind for r in views.timeline(entries, *window, limit=2).collect()] == ["k2", "k1"]


def test_briefing_says_where_there_is_nothing(spark):
    kpis = spark.createDataFrame([(0, "Fires", "3")], "position int, label string, value string")
    changes = spark.createDataFrame([(3, at(-5), "Level crossed")], f"severity int, ts {NTZ}, headline string")
    warnings = spark.createDataFrame([], f"level string, title string, issued {NTZ}")
    points = spark.createDataFrame([(1, "OBSERVED", "Gauge", ["near"])], "position int, kind string, title string, lines array<string>")
    sources = spark.createDataFrame([("Fire", 2.0, "ok"), ("Roads", None, "never")], "source string, age double, state string")
    lines = [r.line for r in views.briefing(now(), 60, kpis, changes, warnings, points, sources).collect()]
    assert lines == ["OPERATIONAL BRIEFING", "Generated 11 Aug 2026 12:00", "Changes since: last 1 hour", "CURRENT SITUATION", "  Fires                        3", "SIGNIFICANT CHANGES (last 1 hour)", "  11:55  [CRITICAL] Level crossed", "ACTIVE WARNINGS", "  None active.", "WATCH POINTS", "  [OBSERVED] Gauge: near", "DATA FRESHNESS", "  Fire           2 min ago", "  Roads          never   <-- CHECK"]


def test_watch_points_and_collection(spark):
    analysed = spark.createDataFrame([("a", 3.0, 2.6, 0.2, 2.0), ("b", 3.0, 2.9, 0.1, None), ("c", 3.0, 1.0, 0.2, None), ("d", 3.0, 2.9, -0.1, None)], "station string, target double, current double, rate double, eta_point double")
    cells = spark.createDataFrame([("1", "strong", 90.0, 40.0, 90.0, 200.0), ("2", "weak", 95.0, 1.0, 1.0, 1.0)], "cell_id string, classification string, intensity_score double, speed_kmh double, bearing_deg double, area_km2 double")
    gusts = spark.createDataFrame([("X", 80.0), ("Y", 60.0), ("Z", 99.0)], "name string, gust double")
    rows = views.watch_points(analysed, cells, gusts).collect()
    assert [(r.kind, r.title) for r in rows] == [("OBSERVED", "b"), ("PROJECTION", "a"), ("OBSERVED", "Storm cell 1"), ("OBSERVED", "Strong wind gusts observed")]
    assert rows[2].lines == ["Strong · E at 40 km/h · ~200 km²"] and rows[3].lines == ["Z — 99 km/h", "X — 80 km/h"]
    features = spark.createDataFrame([('{"type":"Feature"}',), ("bad",), (None,)], "impact_geojson string")
    assert json.loads(views.feature_collection(features).first().geojson) == {"type": "FeatureCollection", "features": [{"type": "Feature"}]}


def test_export_bundle(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0)), (2, at(90))], f"k int, ts {NTZ}")
    made = views.export_bundle({"b": (rows, "ts"), "a": (rows.limit(0), "ts")}, str(tmp_path / "out"), times.at(str(at(-5))), times.at(str(at(5))), format="csv")
    assert [p.rsplit("/", 1)[1] for p in made] == ["a", "b"] and spark.read.csv(made[1], header=True).count() == 1


def fire(spark, *polls):
    names = "source_id string, ts timestamp_ntz, seq long, feed_type string, category1 string, warning_level string, size string, location string, first_seen timestamp_ntz"
    return sorted((r.kind, r.severity, r.headline) for r in detect.fire(spark.createDataFrame([(i, at(t), t, f, "Fire", level, size, "Ash Hill - north", at(t)) for i, t, f, level, size in polls], names), times.at(str(at(-1)))).collect())


def test_fire_detector(spark):
    polls = [("w", 0, "warning", "Advice", None), ("w", 5, "warning", "Advice", None), ("w", 10, "warning", "Emergency Warning", None), ("w", 15, "warning", "Nonsense", None), ("w", 20, "warning", "Watch and Act", None), ("w", -9, "burn-area", "Advice", None)]
    assert fire(spark, *polls) == [("downgrade", 0, "Warning downgraded to Watch and Act — Ash Hill"), ("escalation", 3, "Warning upgraded to Emergency Warning — Ash Hill"), ("new", 2, "New Advice issued")]
    sizes = [("f", k, "incident", None, s) for k, s in enumerate(["90 Ha.", "94 Ha.", "98 Ha.", "120 Ha.", "small", "1,500 ha"])]
    assert fire(spark, *sizes) == [("growth", 2, "Ash Hill fire increased 22 ha"), ("growth", 3, "Ash Hill fire increased 1,380 ha")]


def test_warnings_can_come_back(spark):
    polls = [(0, at(-60), 1), (5, at(-60), 1), (10, at(8), 1), (20, at(8), 0), (25, at(8), 0), (30, at(8), 1), (40, at(8), 0)]
    rows = spark.createDataFrame([("w", at(t), t, issue, at(t), active, "Severe", "flood_watch", "T") for t, issue, active in polls], f"warning_id string, ts {NTZ}, seq long, issue_time {NTZ}, first_seen {NTZ}, active int, group_type string, type string, title string")
    got = sorted((r.kind, r.severity, r.ts) for r in detect.weather(rows, times.at(str(at(-90)))).collect())
    assert got == [("cleared", 0, at(20)), ("cleared", 0, at(40)), ("new", 2, at(-60)), ("reissued", 1, at(8))]


def test_additions_are_idempotent(spark):
    rows = spark.createDataFrame([("a", at(k), k, k % 2 == 0, 0, "R", "L", at(k)) for k in range(4)], f"source_id string, ts {NTZ}, seq long, is_closure boolean, resolved int, road_name string, location string, first_seen {NTZ}")
    found = detect.roads(rows, times.at(str(at(-1))))
    assert found.count() == 4 and detect.additions(found.limit(0), found, found).count() == 4 and detect.additions(found, found).count() == 0


def test_additions_look_at_stored_repeats(spark):
    def entries(*rows):
        made = [(h, kind, 1, "x", at(t), key, "m") for h, kind, key, t in rows]
        df = spark.createDataFrame(made, f"hazard string, kind string, severity int, headline string, ts {NTZ}, entity_key string, metric string")
        null = {"entity_name": "string", "prev_value": "double", "new_value": "double", "prev_label": "string", "new_label": "string", "since": NTZ}
        return df.withColumns({c: F.lit(None).cast(t) for c, t in null.items()}).select(detect.EVENT)

    stored = entries(("flood", "rising", "a", 0), ("flood", "threshold", "b", 0), ("flood", "receding", "c", 0), ("rainfall", "burst", "a", 0))
    found = entries(*[("flood", "rising", key, t) for key in "abcd" for t in (20, 40, 60)], ("flood", "threshold", "d", 19), ("flood", "threshold", "d", 21), ("power", "improving", "s", 1), ("power", "improving", "s", 2), ("power", "deteriorating", "s", 3), ("rainfall", "burst", "a", 31))
    got = sorted((r.hazard, r.entity_key, r.kind, round((r.ts - T0).total_seconds() / 60)) for r in detect.additions(stored, found).collect())
    rising = [("flood", "a", "rising", 40), ("flood", "b", "rising", 40), ("flood", "c", "rising", 20), ("flood", "c", "rising", 60), ("flood", "d", "rising", 60)]
    others = [("flood", "d", "threshold", 19), ("flood", "d", "threshold", 21), ("power", "s", "deteriorating", 3), ("power", "s", "improving", 1), ("rainfall", "a", "burst", 31)]
    assert got == sorted(rising + others)


def test_history_page(spark):
    row = "<tr><td>{}</td><td>{}</td></tr>"
    page = "<table><tr><td>x</td></tr></table><table><tr><th>Date/Time</th><th>Height</th></tr>" + row.format("11/08/2026 09:15", "1.25") + row.format("bad", "2") + row.format("11/08/2026 09:30", "-") + row.format("11/08/2026 09:45", "1.5") + "</table><table><tr><th>Date</th></tr>" + row.format("11/08/2026 10:00", "9") * 5 + "</table>"
    got = feeds.history_rows(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert sorted((r.timestamp, r.height_m) for r in got) == [(dt.datetime(2026, 8, 11, 9, 15), 1.25), (dt.datetime(2026, 8, 11, 9, 45), 1.5)]


@pytest.mark.parametrize("meta, limit, want", [({"total_pages": 2}, 2, 4), ({"total_pages": None}, 2, 5), ({"total_pages": None}, 0, 2)])
def test_pages_stop_where_the_feed_ends(spark, tmp_path, meta, limit, want):
    sizes = [2, 2, 1, 2]
    for k, n in enumerate(sizes, 1):
        doc = {"meta": meta, "data": {"features": [{"properties": {"id": f"{k}.{i}"}, "geometry": {"type": "Point"}} for i in range(n)]}}
        (tmp_path / f"page-{k}.json").write_text(json.dumps(doc))
    assert feeds.read_pages(spark, str(tmp_path), "struct<id:string>", limit=limit).count() == want


def test_more_feeds(spark, tmp_path):
    text = lambda *rows: spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    w = {"id": "1", "state": "VIC", "type": "flood", "issue_time": "2026-08-11T02:00:00Z"}
    rows = feeds.weather_warnings(text({"data": [w, w | {"state": "NSW"}, w | {"id": None}]}), "VIC").collect()
    assert [(r.warning_id, r.issue_time, r.expiry_time) for r in rows] == [("1", dt.datetime(2026, 8, 11, 12), None)]
    assert feeds.warning_versions(text({"data": w}, {"data": w}, {"data": w | {"issue_time": None}})).count() == 1
    keyed = lambda v: spark.createDataFrame([("a", json.dumps(v))], "location_key string, value string")
    r = feeds.rain_polls(keyed({"data": {"rain_since_9am": 1.5}}), keyed({"data": [{"rain": {"amount": {"max": 7}, "chance": 60}}, {"rain": None}]})).first()
    assert tuple(r) == ("a", 1.5, 7.0, 60.0)
    keys = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [r.k for r in feeds.unknown_stations(keys, keys.where("k = 'a'"), "k").collect()] == ["b"]
    frames = spark.createDataFrame([("R", at(-20)), ("R", at(-10)), ("R", at(-5))], f"radar_id string, frame_ts {NTZ}")
    assert [r.frame_ts for r in feeds.new_frames(frames, frames.where(F.col("frame_ts") == times.at(str(at(-5)))), now()).collect()] == [at(-10)]
    (tmp_path / "big flood.csv").write_text("Station,h,event\nX,1.5,\nY,2,other\n")
    got = feeds.flood_csv(spark, str(tmp_path / "big flood.csv"), {"Station": "station_name", "h": "height_m"}, {"station_name": "string", "height_m": "double"}).collect()
    assert {tuple(r) for r in got} == {("X", 1.5, "big flood"), ("Y", 2.0, "other")}
    outage = spark.createDataFrame([("A", "1,000", "planned", "2026-08-11 10:00", None, " True "), (" ", "1", "x", None, None, None)], "location string, customers_off string, type string, first_seen string, last_seen string, restored string")
    assert [tuple(r) for r in feeds.outage_csv(outage).collect()] == [("A", 1000, "planned", dt.datetime(2026, 8, 11, 10), None, 1)]
    assert [tuple(r) for r in feeds.gauge_places(text({" G ": {"latitude": 1.0, "longitude": 2.0, "method": "m"}, "H": {"latitude": None}})).collect()] == [("g", 1.0, 2.0, None, "m")]
    stations = text([["station_no", "station_name", "lat", "lon"], ["1", "In", "-37", "145"], ["2", "Out", "-20", "145"]])
    assert [tuple(r) for r in feeds.station_list(stations, (-39.3, -33.8, 140.5, 150.5)).collect()] == [("1", "In", -37.0, 145.0)]


def test_frames_are_read_as_bytes(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG")
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in feeds.read_frames(spark, str(tmp_path)).collect()] == [("a.png", b"\x89PNG")]
