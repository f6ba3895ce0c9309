"""Targets, reasons, and projections that are settled as they fall due, in batches and as a stream."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.operators import trend
from tidewatch.streaming import jobs

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def levels(spark):
    return spark.createDataFrame([("a", 2.0, 3.0, 4.0), ("b", None, 3.0, None), ("c", None, None, None), ("d", 5.0, 3.0, 4.0)], "station string, minor double, moderate double, major double")


def test_next_target(spark):
    impacts = spark.createDataFrame([("a", 4.5, "x" * 200), ("a", 4.2, "Bridge"), ("a", 4.2, "Alley"), ("b", 9.0, "Town"), ("z", 1.0, "No gauge"), ("a", None, "Unknown")], "station string, height_m double, impact string")
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.999), ("a", 4.0), ("a", 4.2), ("a", 4.5), ("b", 1.0), ("b", 3.0), ("b", 9.0), ("c", 1.0), ("d", 3.5), ("e", 1.0), ("a", None)]
    got = trend.next_target(spark.createDataFrame(rows, "station string, current double"), levels(spark), impacts).collect()
    want = [("class", "minor", 2.0), ("class", "moderate", 3.0), ("class", "major", 4.0), ("impact", "Alley", 4.2), ("impact", "x" * 120, 4.5), (None, None, None), ("class", "moderate", 3.0), ("impact", "Town", 9.0), (None, None, None), (None, None, None), ("class", "minor", 5.0), (None, None, None), (None, None, None)]
    assert {(r.station, r.current, r.target_kind, r.target_name, r.target) for r in got} == {(*r, *w) for r, w in zip(rows, want, strict=True)}
    table = trend.impact_table(impacts, spark.createDataFrame([("a", 4.2), ("b", None)], "station string, current double"), levels(spark))
    assert {(r.station, r.height_m, r.priority, r.reached) for r in table.where("height_m IS NOT NULL").collect()} == {("a", 4.5, 1, False), ("a", 4.2, 1, True), ("b", 9.0, 2, False), ("z", 1.0, 4, False)}


def test_reasons(spark):
    lines = {"a": [(k, 1.0 + k / 60) for k in range(0, 60, 10)], "few": [(0, 1.0), (1, 2.0)], "b": [(k, 9.5 + k / 60) for k in range(0, 60, 10)], "c": [(k, 1.0) for k in range(0, 60, 10)], "far": [(k, 1.0 + k / 1000) for k in range(0, 60, 10)]}
    readings = spark.createDataFrame([(s, at(k), k, h) for s, xs in lines.items() for k, h in xs] + [("a", at(-500), 9, 50.0), ("a", at(90), 9, 50.0)], f"station string, ts {NTZ}, seq long, height double")
    far = spark.createDataFrame([("far", 90.0, None, None)], "station string, minor double, moderate double, major double")
    none = spark.createDataFrame([], "station string, height_m double, impact string")
    rows = {r.station: r for r in trend.analysis(readings, levels(spark).union(far), none, times.at(str(at(60)))).collect()}
    assert {s: (r.eta_reason or "")[:12] for s, r in rows.items()} == {"a": "", "few": "Only 2 readi", "b": "Already abov", "c": "Already abov", "far": "At the curre"}
    assert rows["few"].headline == "Insufficient data" and rows["few"].rate is None and rows["a"].target == 2.0
    made = trend.projections(trend.analysis(readings, levels(spark), none, times.at(str(at(60)))), times.at(str(at(61)))).collect()
    assert [(r.station, r.observed_at, r.target_name, r.readings, r.lead_minutes, r.eta_point) for r in made] == [("a", at(50), "minor", 6, 10, at(60))]


def test_near_flood_is_exact_at_the_share(spark):
    rows = [("a", 42.4, 53), ("b", 32.8, 41), ("c", 44.8, 56), ("d", 42.39, 53), ("e", 44.81, 56), ("f", None, 53), ("g", 1.0, None)]
    for kind in ("long", "double"):
        levels = spark.createDataFrame(rows, "station string, height double, minor long").withColumn("minor", F.col("minor").cast(kind))
        assert {r.station for r in trend.near_flood(levels, 0.8).collect()} == {"a", "b", "c", "e"}


def sample(seed):
    """Readings every ten minutes of three gauges, and projections made from some."""
    rng = random.Random(seed)
    readings, made = [], []
    for s in "abc":
        h = 2.0
        for k in range(120):
            h += rng.uniform(-0.3, 0.3)
            readings.append((s, at(10 * k), k, round(h, 3)))
            if rng.random() < 0.3 and k < 80:
                t = at(10 * k)
                eta = [t + dt.timedelta(minutes=m) for m in sorted(rng.randrange(5, 240) for _ in range(3))]
                made.append((len(made), s, t, h, h + rng.uniform(-0.1, 2.5), *eta))
    return readings, made


READING, MADE = f"station string, ts {NTZ}, seq long, height double", f"id long, station string, observed_at {NTZ}, current double, target double, eta_early {NTZ}, eta_point {NTZ}, eta_late {NTZ}"


def test_settled_equals_a_walk(spark):
    readings, made = sample(1)
    now = at(600)
    want = {}
    for i, s, t, current, target, early, point, late in made:
        due = late + dt.timedelta(hours=3)
        after = [(ts, h) for k, ts, _, h in readings if k == s and t < ts <= min(due, now)]
        hit = next((ts for ts, h in after if h >= target), None)
        if hit:
            want[i] = ("reached", hit, round((hit - point).total_seconds() / 60, 6), int(early <= hit <= late))
        elif now >= due:
            want[i] = ("receded" if after and after[-1][1] < current else "not_reached", None, None, 0)
        else:
            want[i] = (None, None, None, None)
    rows = trend.settle(spark.createDataFrame(made, MADE), spark.createDataFrame(readings, READING), times.at(str(now))).collect()
    assert {r.id: (r.outcome, r.actual_ts, r.error_minutes if r.error_minutes is None else round(r.error_minutes, 6), r.within_range) for r in rows} == want
    assert {w[0] for w in want.values()} == {"reached", "receded", "not_reached", None}
    open_ = trend.pending_counts(spark.createDataFrame([(s, w[0]) for (_, s, *_), w in zip(made, want.values(), strict=True)], "station string, outcome string"))
    assert sum(r.pending for r in open_.collect()) == sum(w[0] is None for w in want.values())


def test_stream_settles_as_batches_do(spark, tmp_path):
    readings, made = sample(2)
    schema = f"{READING}, id long, current double, target double, eta_early {NTZ}, eta_point {NTZ}, eta_late {NTZ}"
    rows = [(*r, *[None] * 6) for r in readings] + [(s, t, None, None, i, c, x, *e) for i, s, t, c, x, *e in made]
    rows += [(s, at(9000 + k), 0, 0.0, *[None] * 6) for k in range(2) for s in "abc"]
    edges = [-1, 150, 400, 401, 700, 1300, 9000, 9001]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = [r for r in rows if at(low) < r[1] <= at(high)]
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.settle_projections(stream, late="10 minutes").writeStream.format("memory").queryName("settled").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {r.id: (r.outcome, r.actual_ts, r.within_range) for r in spark.table("settled").collect()}
    want = trend.settle(spark.createDataFrame(made, MADE), spark.createDataFrame(readings, READING), F.lit(at(8000)).cast(NTZ)).collect()
    assert len(want) > 50 and spark.table("settled").count() == len(want)
    assert got == {r.id: (r.outcome, r.actual_ts, r.within_range) for r in want}
