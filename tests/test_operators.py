"""Operators and feeds on hand-made rows."""

import datetime as dt
import difflib
import json
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import geo, text, times
from tidewatch.operators import changes, radar, spatial, temporal, trend
from tidewatch.sources import feeds, png

T0 = dt.datetime(2026, 8, 11, 12)
at = lambda m: T0 + dt.timedelta(minutes=m)
NTZ = "timestamp_ntz"


def test_reset_proof_total(spark):
    rows = [("94839", 1.4, "2026-08-01 09:30"), ("94839", 3.8, "2026-08-01 10:00"), ("94839", 6.0, "2026-08-01 11:00"), ("94839", 0.4, "2026-08-02 09:30"), ("94839", None, "2026-08-02 10:00"), ("94839", 2.5, "2026-08-02 10:30"), ("95839", 0.0, "2026-08-01 09:30")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq long, wmo string, rain double, t string").withColumn("ts", F.col("t").cast(NTZ))
    got = {r.wmo: r.total for r in temporal.reset_total(df, ["wmo"], "ts", "seq", "rain").collect()}
    assert got["94839"] == pytest.approx(7.1) and got["95839"] == 0.0


def journal_of(spark):
    rows = [(0, 214, 1), (30, 296, 1), (70, 340, 1), (330, 340, 0)]
    return spark.createDataFrame([("fire", "a", at(m), area, active, k) for k, (m, area, active) in enumerate(rows)], f"source string, entity_key string, effective_ts {NTZ}, area int, active int, seq long")


@pytest.mark.parametrize("minute, area", [(-30, None), (0, 214), (29, 214), (30, 296), (69, 296), (70, 340), (329, 340), (330, None), (600, None)])
def test_state_at(spark, minute, area):
    when = times.at(str(at(minute)))
    got = [r.area for r in temporal.state_at(journal_of(spark), when).collect()]
    assert got == ([] if area is None else [area])
    if minute >= 330:
        assert [r.active for r in temporal.state_at(journal_of(spark), when, include_inactive=True).collect()] == [0]


def test_states_between_and_change_times(spark):
    j = journal_of(spark)
    assert temporal.states_between(j, times.at(str(at(10))), times.at(str(at(80)))).count() == 2
    assert {r[0] for r in temporal.change_times(j, times.at(str(at(-60))), times.at(str(at(330)))).collect()} == {at(m) for m in (0, 30, 70, 330)}


def test_journal_batch_writes_changes_and_tombstones(spark):
    schema = f"source string, entity_key string, effective_ts {NTZ}, state_hash string, seq long"
    first = spark.createDataFrame([("f", "a", at(0), "x", 1), ("f", "b", at(0), "y", 2)], schema)
    empty = first.withColumn("active", F.lit(1)).limit(0)
    j = changes.journal_batch(empty, first, times.at(str(at(1))))
    assert j.count() == 2
    j = j.select(empty.columns)
    assert changes.journal_batch(j, first, times.at(str(at(5)))).count() == 0
    second = spark.createDataFrame([("f", "a", at(9), "z", 11)], schema)
    got = {(r.entity_key, r.active, r.effective_ts) for r in changes.journal_batch(j, second, times.at(str(at(9)))).collect()}
    assert got == {("a", 1, at(9)), ("b", 0, at(0))}
    got = {(r.entity_key, r.active, r.effective_ts) for r in changes.journal_batch(j, second, times.at(str(at(9))), tombstone_time="recorded").collect()}
    assert ("b", 0, at(9)) in got


def test_new_rows_first_write_wins_and_null_keys_stay(spark):
    schema = "k string, h double, v string, seq long"
    new = spark.createDataFrame([("a", 1.0, "first", 1), ("a", 1.0, "second", 2), ("a", None, "n1", 3), ("a", None, "n2", 4), ("b", 2.0, "x", 5)], schema)
    old = spark.createDataFrame([("b", 2.0, "stored", 0)], schema)
    assert sorted(r.v for r in changes.new_rows(old, new, ["k", "h"], "seq").collect()) == ["first", "n1", "n2"]


def test_sweep_spares_all_when_the_feed_is_empty(spark):
    t = spark.createDataFrame([("a", 0, at(0)), ("b", 0, at(0)), ("c", 1, at(0))], f"id string, resolved int, last_seen {NTZ}")
    feed = t.where("id = 'a'").select("id")
    now = times.at(str(at(9)))
    assert {(r.id, r.resolved) for r in changes.sweep(t, feed, "id", now).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {r.resolved for r in changes.sweep(t, feed.limit(0), "id", now).where("id <> 'c'").collect()} == {0}
    assert {r.resolved for r in changes.sweep(t, feed.limit(0), "id", now, empty_means_none=True).collect()} == {1}


def random_series(seed, n=200):
    rng = random.Random(seed)
    return [(k, rng.choice("abc"), T0 + dt.timedelta(minutes=rng.randrange(8000)), round(rng.uniform(0, 10), 2)) for k in range(n)]


def test_previous_and_first_hit_equal_brute_force(spark):
    rows = random_series(1)
    df = spark.createDataFrame(rows, f"seq long, station string, ts {NTZ}, height double")
    got = {r.seq: r.prev_height for r in temporal.with_previous(df, ["station"], "ts", "seq", ["height"]).collect()}
    for key in "abc":
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        for before, now in zip([None, *own], own, strict=False):
            assert got[now[0]] == (before and before[3])
    asked = [(k, random.Random(k).choice("abc"), T0 + dt.timedelta(minutes=97 * k), 5 + k / 10) for k in range(60)]
    want = {i: min(ts for _, s, t, h in rows if s == key and t > after and h >= target for ts in [t]) for i, key, after, target in asked if any(s == key and t > after and h >= target for _, s, t, h in rows)}
    frame = spark.createDataFrame(asked, f"id long, station string, after {NTZ}, target double")
    assert {r.id: r.hit_ts for r in temporal.first_hit(frame, df, "station", "id").collect()} == want


def test_overlaps_and_asof_equal_brute_force(spark):
    rng = random.Random(4)
    span = lambda n, most: [(k, s := T0 + dt.timedelta(hours=rng.randrange(900)), s + dt.timedelta(hours=rng.randrange(most))) for k in range(n)]
    a, b = span(80, 600), span(20, 300)
    left = spark.createDataFrame(a, f"i long, start {NTZ}, end {NTZ}")
    right = spark.createDataFrame(b, f"j long, w_start {NTZ}, w_end {NTZ}")
    want = {(i, j) for i, s, e in a for j, p, q in b if s <= q and e >= p}
    got = [(r.i, r.j) for r in temporal.overlaps(left, right, days=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    series = spark.createDataFrame([(k, t) for k, t, _ in a], f"v long, ts {NTZ}")
    times_ = spark.createDataFrame([(T0 + dt.timedelta(hours=7 * k),) for k in range(100)], f"at {NTZ}")
    for r in temporal.asof_series(times_, series, order=["ts", "v"]).collect():
        fits = [(t, k) for k, t, _ in a if r.at - dt.timedelta(hours=6) <= t <= r.at]
        assert r.v == (max(fits)[1] if fits else None)


def test_radius_totals_pair_places_not_rows(spark):
    rng = random.Random(4)
    place = lambda: rng.choice([(-37.0, 145.0), (-37.0, 145.3), (-37.4, 145.0), (10.0, 10.0), (None, 145.0)])
    a, b = ([(k, *place()) for k in range(n)] for n in (300, 400))
    left, right = spark.createDataFrame(a, "i long, lat double, lon double"), spark.createDataFrame(b, "j long, lat double, lon double")
    got = spatial.radius_totals(left, right, 40.0, [F.count("*").alias("n"), F.max("j").alias("top")], [F.sum("n").alias("n"), F.max("top").alias("top"), F.max("km").alias("far")])
    pairs = [(r.i, r.j) for r in spatial.radius_join(left, right, 40.0).collect()]
    want = {}
    for i, j in pairs:
        n, top = want.get(i, (0, -1))
        want[i] = (n + 1, max(top, j))
    assert {r.i: (r.n, r.top) for r in got.collect()} == want and len(pairs) > 10_000
    # a row of an accumulator for each pair that meets: 4 places have 6 near pairs at most, but 120,000 rows do
    met = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (met.add(1), x)[1], "double")
    spatial.radius_totals(left, right, 40.0, [F.count("*").alias("n")], [F.sum(count("km")).alias("s")]).collect()
    assert 0 < met.value < 50


def test_radius_join_equals_brute_force(spark):
    rng = random.Random(2)
    pts = lambda n: [(k, rng.uniform(-39, -36), rng.uniform(141, 147)) for k in range(n)] + [(n, None, 142.0)]
    a, b = pts(60), pts(60)
    got = {(r.i, r.j) for r in spatial.radius_join(spark.createDataFrame(a, "i long, lat double, lon double"), spark.createDataFrame(b, "j long, lat double, lon double"), 40.0).collect()}

    def km(p, q):
        f, g = math.radians(p[1]), math.radians(q[1])
        h = math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 12742 * math.asin(math.sqrt(h))

    assert got == {(p[0], q[0]) for p in a[:-1] for q in b[:-1] if km(p, q) <= 40.0}
    far = [(k, rng.uniform(-90, 90) if k % 2 else rng.choice([-89.9, 89.8]), rng.choice([-180.0, 179.9, -179.9, 180.0]) + rng.uniform(-0.1, 0.1)) for k in range(300)]
    frame = spark.createDataFrame(far, "i long, lat double, lon double")
    got = {(r.i, r.j) for r in spatial.radius_join(frame, frame.withColumnRenamed("i", "j"), 300.0).collect()}
    assert got == {(p[0], q[0]) for p in far for q in far if km(p, q) <= 300.0} and len(got) > 1000


def test_clusters_are_anchored_on_the_gravest(spark):
    day = T0.date()
    rows = [(day, 1, "flood", 3, at(0), -37.0, 145.0), (day, 2, "roads", 2, at(5), -37.0, 145.03), (day, 3, "roads", 2, at(6), -37.0, 145.2), (day, 4, "fire", 2, at(1), None, 145.0)]
    df = spark.createDataFrame(rows, f"day date, event_id long, hazard string, severity int, ts {NTZ}, lat double, lon double")
    assert {(r.event_id, r.cluster_id, r.hazards) for r in spatial.clusters(df).collect()} == {(1, 1, 2), (2, 1, 2)}


def brute_clusters(rows, km):
    anchors, out = [], {}
    for _, event, hazard, _, _, lat, lon in sorted(rows, key=lambda r: (-r[3], -r[4].timestamp(), r[1])):
        near = next((a for a, p in anchors if spatial._distance(p, (math.radians(lat), math.radians(lon))) <= km), None)
        if near is None:
            anchors.append((event, (math.radians(lat), math.radians(lon))))
        out.setdefault(event if near is None else near, []).append((event, hazard))
    return {(e, c, len({h for _, h in held})) for c, held in out.items() for e, _ in held if len({h for _, h in held}) > 1}


def test_clusters_equal_brute_force(spark):
    rng = random.Random(9)
    days = [T0.date(), T0.date() + dt.timedelta(days=1)]
    rows = [(days[k % 2], k, rng.choice(["flood", "fire", "roads"]), rng.randrange(2, 4), at(rng.randrange(50)), rng.uniform(-37.2, -37), rng.choice([145.0, 179.99, -179.99]) + rng.uniform(0, 0.2)) for k in range(300)]
    df = spark.createDataFrame([*rows, (None, 999, "fire", 3, at(0), -37.0, 145.0)], f"day date, event_id long, hazard string, severity int, ts {NTZ}, lat double, lon double")
    got = {(r.event_id, r.cluster_id, r.hazards) for r in spatial.clusters(df).collect()}
    assert got == set().union(*(brute_clusters([r for r in rows if r[0] == d], 10.0) for d in days)) and len(got) > 200


def test_tracks_follow_frames_in_order(spark):
    rng = random.Random(4)
    rows = [(radar, at(10 * k), 100 * k + d, 50.0 * d + 3 * k + rng.random(), 40.0 * (d % 3), 30.0) for radar in ("a", "b") for k in range(12) for d in range(6)]
    df = spark.createDataFrame(rows, f"radar_id string, ts {NTZ}, det long, x double, y double, area double")
    got = {(r.radar_id, r.det): (r.cell, r.speed_kmh, r.status) for r in spatial.cell_tracks(df.union(df.limit(1).withColumn("x", F.lit(None).cast("double")))).collect()}
    for radar in ("a", "b"):
        tracker = spatial.Tracker()
        for k in range(12):
            frame = sorted(r for r in rows if r[0] == radar and r[1] == at(10 * k))
            for r, made in zip(frame, tracker.step(600.0 * k, [r[3:] for r in frame], 1.0), strict=True):
                cell, speed, status = got[radar, r[2]]
                assert (cell, status) == (made[0], made[3]) and (speed is None) == (made[1] is None) and (speed is None or speed == pytest.approx(made[1], rel=1e-6))
    assert {cell for cell, _, _ in got.values()} == set(range(1, 7))


def test_tracker_coasts_and_measures(spark):
    t = spatial.Tracker()
    first = t.step(0.0, [(100.0, 100.0, 50.0)], 1.0)
    assert first == [(1, None, None, "new")]
    cell, speed, heading, _ = t.step(300.0, [(102.0, 100.0, 50.0)], 1.0)[0]
    assert cell == 1 and speed == pytest.approx(24.0) and heading == pytest.approx(90.0)
    for k in range(3):
        t.step(600.0 + k, [], 1.0)
    assert t.step(1500.0, [(110.0, 100.0, 50.0)], 1.0)[0][0] == 1
    for k in range(4):
        t.step(1600.0 + k, [], 1.0)
    assert t.step(2000.0, [(110.0, 100.0, 50.0)], 1.0)[0][0] == 2


def painted(blocks, size=96):
    frame = np.zeros((size, size, 4), np.uint8)
    for y, x, h, w, level in blocks:
        frame[y : y + h, x : x + w] = (*radar.PALETTE[level - 1], 255)
    return frame


def cells_of(blocks, before=None):
    frame = painted(blocks)
    return radar.detect_cells(frame[:, :, :3], frame[:, :, 3], 1.0, before)


def test_radar_cells():
    cells = cells_of([(10, 20, 20, 10, 12), (60, 5, 2, 5, 12), (60, 60, 12, 12, 2)])
    assert len(cells) == 1 and (cells[0]["x"], cells[0]["y"], cells[0]["pixels"], cells[0]["max_level"]) == (24.5, 19.5, 200, 12)
    assert cells[0]["classification"] == "strong" and cells[0]["intensity_score"] == pytest.approx(4 * 12 + 2.5 * 12 + 200 / 15)
    near = [(10, 20, 20, 10, 5), (10, 38, 20, 10, 5)]  # eight pixels apart: one cell
    assert [c["pixels"] for c in cells_of(near)] == [400]
    apart = [(10, 20, 20, 10, 5), (10, 50, 20, 10, 5)]  # twenty apart: two, unless they were one before
    assert [c["pixels"] for c in cells_of(apart)] == [200, 200]
    before = np.zeros((96, 96), np.int32)
    before[12:28, 22:58] = 7
    assert [c["pixels"] for c in cells_of(apart, before)] == [400]
    before[:, 50:] *= 2
    assert [c["pixels"] for c in cells_of(apart, before)] == [200, 200]


@pytest.mark.parametrize("corners", [True, False])
def test_label_equals_flood_fill(corners):
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((17, 23)) < 0.5
        got, n = radar.label(mask, corners=corners)
        want, todo, left = {}, [], {tuple(p) for p in np.argwhere(mask).tolist()}
        while left:
            todo, number = [left.pop()], len(set(want.values())) + 1
            while todo:
                y, x = todo.pop()
                want[y, x] = number
                for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1), *([(-1, -1), (-1, 1), (1, -1), (1, 1)] if corners else [])):
                    if (y + dy, x + dx) in left:
                        left.discard((y + dy, x + dx))
                        todo.append((y + dy, x + dx))
        assert n == len(set(want.values())) and (got > 0).tolist() == mask.tolist()
        assert len({(want[tuple(p)], got[tuple(p)]) for p in np.argwhere(mask).tolist()}) == n


def png_of(kind, depth, rows, extra=b"", filters=None):
    raw = b"".join(bytes([f]) + r for f, r in zip(filters or [0] * len(rows), rows, strict=True))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    width = len(rows[0]) * 8 // depth // png.SAMPLES[kind]
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_colour_types_and_filters():
    frame = np.random.default_rng(1).integers(0, 255, (5, 7, 4), np.uint8)
    colours, alpha = png.decode(png.encode(frame))
    assert (colours == frame[:, :, :3]).all() and (alpha == frame[:, :, 3]).all()
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 4, 5, 6]) + b"\0\0\0\0" + struct.pack(">I", 1) + b"tRNS" + b"\x09" + b"\0\0\0\0"
    colours, alpha = png.decode(png_of(3, 1, [bytes([0b01000001])], palette))
    assert colours[0, 1].tolist() == [4, 5, 6] and alpha[0].tolist() == [9, 255, 9, 9, 9, 9, 9, 255]
    colours, alpha = png.decode(png_of(4, 8, [bytes([10, 1, 20, 2])]))
    assert colours[0].tolist() == [[10] * 3, [20] * 3] and alpha[0].tolist() == [1, 2]
    grey = [bytes([10, 20, 30]), bytes([1, 1, 1]), bytes([5, 5, 5]), bytes([2, 2, 2]), bytes([1, 0, 3])]
    rows = png.decode(png_of(0, 8, grey, filters=[0, 1, 2, 3, 4]))[0][:, :, 0].tolist()
    assert rows == [[10, 20, 30], [1, 2, 3], [6, 7, 8], [5, 8, 10], [6, 8, 13]]
    assert png.decode(b"no") is None and png.decode(None) is None and png.decode(png.encode(frame)[:60]) is None


def test_storm_cells_are_followed(spark):
    frames = [("IDR023", at(5 * k), png.encode(painted([(40, 10 + 2 * k, 14, 14, 9), (5, 70, 12, 12, 3)], 128))) for k in range(6)]
    rows = [*frames, ("IDR023", at(60), b"broken"), (None, at(1), frames[0][2]), ("XDR991", at(0), frames[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], f"radar_id string, ts {NTZ}, image binary, status string")
    got = radar.storm_cells(df, {"IDR02": (-37.8, 144.8)}).collect()
    own = sorted((r for r in got if r.radar_id == "IDR023" and r.max_level == 9), key=lambda r: r.ts)
    assert len(got) == 14 and len({r.cell_id for r in own}) == 1 and [r.status for r in own] == ["new"] + ["tracked"] * 5
    assert own[-1].bearing_deg == pytest.approx(90, abs=1) and own[-1].speed_kmh == pytest.approx(2 / 5 * 60 * radar.scale_of("IDR023", 128), rel=0.01)
    ring = json.loads(own[-1].impact_geojson)["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and max(p[0] for p in ring) > own[-1].longitude > min(p[0] for p in ring)
    assert all(r.impact_geojson is None and r.latitude is None for r in got if r.radar_id == "XDR991")
    assert {(r.alert_type, r.classification, r.ts) for r in radar.storm_alerts(spark.createDataFrame([("a", "weak", at(0)), ("a", "moderate", at(1)), ("a", "strong", at(2)), ("a", "moderate", at(3)), ("b", "strong", at(0)), ("b", "moderate", at(4))], f"cell_id string, classification string, ts {NTZ}")).collect()} == {("new_cell", "moderate", at(1)), ("escalation", "strong", at(2)), ("new_cell", "strong", at(0))}
    assert radar.storm_cells(df.limit(0)).count() == 0


def test_trend_equals_numpy(spark):
    rng = np.random.default_rng(3)
    hours = np.sort(rng.uniform(0, 3, 12)).round(3)
    heights = 1 + 0.4 * hours + rng.normal(0, 0.02, 12)
    rows = [(k, "g", T0 + dt.timedelta(seconds=float(h) * 3600), float(y)) for k, (h, y) in enumerate(zip(hours, heights, strict=True))]
    df = spark.createDataFrame(rows, f"seq long, station string, ts {NTZ}, height double")
    r = trend.analyse(trend.fits(df, "station"), F.lit(3.0)).first()
    x = hours - hours[0]
    (slope, cut), res = np.polyfit(x, heights, 1, full=True)[:2]
    assert r.rate == pytest.approx(slope, rel=1e-4) and r.stderr == pytest.approx(math.sqrt(res[0] / 10 / ((x - x.mean()) ** 2).sum()), rel=1e-3)
    assert r.headline.startswith("Rising") and r.eta_early < r.eta_point < r.eta_late <= 12
    assert trend.analyse(trend.fits(df.limit(3), "station"), F.lit(3.0)).count() == 0


@pytest.mark.parametrize("raw, value, time", [("4602:40pm", 46.0, "02:40pm"), ("10601:17am", 106.0, "01:17am"), ("10.011:00pm", 10.0, "11:00pm"), ("-1.606:35pm", -1.6, "06:35pm"), ("46", 46.0, None), ("-", None, None), ("garbage", None, None), ("", None, None)])
def test_value_time(spark, raw, value, time):
    r = spark.createDataFrame([(raw,)], "c string").select(text.value_time(F.col("c")).alias("v")).first().v
    assert (r.value, r.time) == (value, time)


def test_wording(spark):
    one = spark.range(1)
    show = lambda c: one.select(c.alias("x")).first().x
    ages = [(None, "never"), (0.5, "just now"), (4.0, "4 min ago"), (75.0, "75 min ago"), (130.0, "2 hr 10 min ago"), (120.0, "2 hr ago")]
    assert [show(times.describe_age(F.lit(a).cast("double"))) for a, _ in ages] == [w for _, w in ages]
    assert [show(times.duration(F.lit(m).cast("double"))) for m in (240, 45, 390, 3060)] == ["4h 00m", "45m", "6h 30m", "2d 3h"]
    assert show(text.gauge_town(F.lit("Avoca River at Charlton (town) HG"))) in ("Charlton", "Charlton (town)")
    assert show(text.hectares(F.lit("about 7,223.24 Ha."))) == 7223.24
    got = show(geo.geohash_centre(F.lit("ezs42")))
    assert got.latitude == pytest.approx(42.605, abs=0.03) and got.longitude == pytest.approx(-5.603, abs=0.03)
    assert show(times.iso_to_local(F.lit("2026-08-11T02:00:00Z"))) == dt.datetime(2026, 8, 11, 12) and show(times.iso_to_local(F.lit("soon"))) is None


def test_weather_page(spark):
    row = '<tr><th headers="x"><a href="/products/IDV60801/IDV60801.{0}.shtml">{1}</a></th><td headers="t1-datetime">{2}</td>{3}</tr>'
    cells = ['<td headers="t1-temp">10.1</td>', '<td headers="t1-wind-gust-kph">N/A</td>', '<td headers="t1-gust-max-kph">4602:40pm</td>', '<td headers="t1-unknown">9</td>', '<td headers="t1-apptmp">8.4</td>']
    page = "<table>" + row.format(94839, "Charlton", "11/11:30am", "".join(cells)) + row.format(94840, "Other", "11/11:30am", "".join(reversed(cells))) + row.format(94801, "Silent Hill", "-", "") + "<tr><td>Notes</td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    rows = feeds.weather_rows(df, times.at(str(T0))).orderBy("wmo").collect()
    assert [(r.wmo, r.name) for r in rows] == [("94839", "Charlton"), ("94840", "Other")]
    for r in rows:
        assert (r.temperature_c, r.apparent_temperature_c, r.wind_gust_kmh, r.max_gust_kmh, r.max_gust_time, r.pressure_msl_hpa, r.obs_time) == (10.1, 8.4, None, 46.0, "02:40pm", None, dt.datetime(2026, 8, 11, 11, 30))


def test_gauge_page(spark):
    page = "<table><tr><th>Loddon</th></tr><tr><td>Bridge at X</td><td>r</td><td>11.31AM Tue</td><td>1.25</td><td>d</td><td>rising</td><td></td><td>minor</td><td></td></tr><tr><td>Y</td></tr></table>"
    got = feeds.gauge_rows(spark.createDataFrame([(1, page)], "page_id long, html string"), times.at(str(T0))).collect()
    assert [(r.catchment, r.station_name, r.height_m, r.tendency, r.classification, r.timestamp) for r in got] == [("Loddon", "Bridge at X", 1.25, "rising", "minor", dt.datetime(2026, 8, 11, 11, 31))]


def test_geojson_feeds(spark, tmp_path):
    f = {"properties": {"id": "1", "feedType": "warning", "category1": "Advice", "status": "Safe", "location": "Here", "created": "2026-08-11T02:00:00Z"}, "geometry": {"type": "Polygon", "coordinates": [[[145, -37], [146, -37], [146, -38], [145, -38]]]}}
    for k, doc in enumerate([{"type": "FeatureCollection", "features": [f]}, {"meta": {}, "data": {"features": [f]}}, [f]]):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
        r = feeds.incidents(feeds.read_features(spark, str(tmp_path / f"{k}.json"), feeds.INCIDENT)).first()
        assert (r.source_id, r.warning_level, r.resolved, r.headline, r.latitude, r.longitude) == ("1", "Advice", 1, "Here", -37.5, 145.5) and r.geometry
    road = {"properties": {"id": "7", "status": "Active", "roadAccessType": "Lane closed", "closedRoadName": "A St", "eventType": "Flood"}, "geometry": {"type": "Point", "coordinates": [145.0, -37.0]}}
    (tmp_path / "r.json").write_text(json.dumps([road]))
    r = feeds.disruptions(feeds.read_features(spark, str(tmp_path / "r.json"), feeds.ROAD)).first()
    assert (r.is_closure, r.road_name, r.disruption_type, r.latitude) == (0, "A St", "Flood", -37.0)


def test_small_feeds(spark, tmp_path):
    rows = spark.createDataFrame([("A, B , ", "1,204", "planned")], "location string, customers string, type string")
    assert [(r.location, r.customers_off) for r in feeds.outage_rows(rows).collect()] == [("A", 1204), ("B", 1204)]
    (tmp_path / "x.csv").write_text("Station,h,other\nX,1.5,9\nY,bad,9\n")
    got = feeds.read_csv(spark, str(tmp_path / "x.csv"), {"Station": "station_name", "h": "height_m"}, {"station_name": "string", "height_m": "double", "event": "string"}).collect()
    assert [tuple(r) for r in got] == [("X", 1.5, None), ("Y", None, None)]
    places = spark.createDataFrame([('{"a":[1.0,2.0],"b":[1.0]}',)], "value string")
    assert [tuple(r) for r in feeds.place_map(places).collect()] == [("a", 1.0, 2.0)]
    guide = spark.createDataFrame([('{"guides":[{"station":" X ","town":"T","source":"s","impacts":[{"height_m":2.5,"impact":"road"}]}]}',)], "value string")
    assert [tuple(r) for r in feeds.guide_impacts(guide).collect()] == [("x", "T", "s", 2.5, "road")]
    lines = spark.createDataFrame([("2.50 m - Road closed",), ("no height",)], "line string")
    assert [tuple(r) for r in feeds.impact_lines(lines).collect()] == [(2.5, "Road closed")]


def match_frames(spark, names, gauges):
    toks = lambda x: [t for t in x.split() if t not in ("river", "at")]
    left = [(n, " ".join(toks(n)), toks(n)) for n in names]
    right = [(f"G{k}", " ".join(toks(g)), toks(g), k) for k, g in enumerate(gauges)]
    return left, right, (spark.createDataFrame(left, "name string, key string, tokens array<string>"), spark.createDataFrame(right, "gauge string, g_key string, g_tokens array<string>, seq long"))


def brute_match(left, right):
    by_key = {}
    for gauge, key, tokens, _ in right:
        if key:
            by_key.setdefault(key, (gauge, set(tokens)))
    out = {}
    for name, key, tokens in left:
        if not key:
            continue
        if key in by_key:
            out[name] = (by_key[key][0], "exact", "high", 1.0)
            continue
        t = set(tokens)
        part = next(((g, ts) for g, ts in by_key.values() if (t <= ts or ts <= t) and tokens[0] in ts and len(t & ts) >= 2), None)
        if part:
            out[name] = (part[0], "subset", "medium", round(len(t & part[1]) / len(t | part[1]), 2))
        elif best := difflib.get_close_matches(key, list(by_key), n=1, cutoff=0.85):
            score = difflib.SequenceMatcher(None, key, best[0]).ratio()
            out[name] = (by_key[best[0]][0], "fuzzy", "medium" if score >= 0.92 else "low", round(score, 3))
    return out


def test_fuzzy_match(spark):
    names = ["bridge st", "loddon", "avocaweir", "lodon", "avoca weirr", "none", "", "mount avoca weir", "st bridge"]
    gauges = ["bridge st", "loddon", "avoca weir", "avoca weir", "", "river st bridge end"]
    left, right, frames = match_frames(spark, names, gauges)
    got = {r.name: tuple(r)[1:] for r in spatial.fuzzy_match(*frames).collect()}
    assert got == brute_match(left, right)
    assert got["avocaweir"][1] == got["lodon"][1] == "fuzzy" and got["st bridge"][1] == "subset" and "mount avoca weir" not in got


@pytest.mark.parametrize("seed", range(2))
def test_fuzzy_match_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcd", k=rng.randrange(1, 8)))
    gauges = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)]

    def typo(x):
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(x) + 1)
            x = x[:k] + rng.choice(["", "a", " ", "d"]) + x[k + rng.randrange(2) :]
        return x

    names = sorted({typo(rng.choice(gauges)) for _ in range(150)} | {" ".join(g.split()[:2]) for g in gauges[:30]})
    left, right, frames = match_frames(spark, names, gauges)
    got = {r.name: tuple(r)[1:] for r in spatial.fuzzy_match(*frames).collect()}
    want = brute_match(left, right)
    assert got == want and {m for _, m, _, _ in want.values()} == {"exact", "subset", "fuzzy"}
