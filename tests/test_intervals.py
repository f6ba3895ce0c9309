"""Spans, instants within them, and layers as they stood."""

import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewatch.functions import times
from tidewatch.operators import intervals, replay

T0 = dt.datetime(2026, 8, 11, 12)
NTZ = "timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_stab_equals_all_pairs(spark):
    rng = random.Random(1)
    when = lambda: rng.choice([None, at(rng.randrange(-10_000, 10_000)), at(rng.random() * 100), at(rng.choice([-3_000_000, 4_000_000])), dt.datetime(1969, 12, 31, 23, rng.randrange(60))])
    spans = [(k, when(), when(), when()) for k in range(400)]
    asked = [(k, when()) for k in range(150)] + [(200 + k, spans[k][1 + k % 3]) for k in range(60)]
    want = Counter((s, i) for s, start, end, until in spans for i, t in asked if t is not None and start is not None and start <= t and (end is None or t < end) and (until is None or t <= until))
    got = intervals.stab(spark.createDataFrame(spans, f"k long, start {NTZ}, end {NTZ}, until {NTZ}"), spark.createDataFrame(asked, f"i long, at {NTZ}"))
    assert len(want) > 1000 and Counter((r.k, r.i) for r in got.collect()) == want


def test_a_long_span_is_few_nodes(spark):
    rows = spark.createDataFrame([(at(3), None), (at(0), at(60 * 24 * 365 * 20)), (at(0), at(0))], f"a {NTZ}, b {NTZ}").select(F.size(intervals.nodes(F.col("a"), F.col("b"))).alias("n")).collect()
    assert rows[0].n <= 34 and rows[1].n <= 48 and rows[2].n == 1


def test_validity(spark):
    rows = [("a", at(0), 1, "x"), ("a", at(0), 2, "y"), ("a", at(2000), 3, "z"), ("b", None, 4, "n"), ("b", at(5), 5, "w")]
    df = spark.createDataFrame(rows, f"k string, ts {NTZ}, seq long, v string")
    got = {(r.v, r.start, r.end, r.until) for r in intervals.validity(df, ["k"], "ts", "seq", max_age=F.expr("INTERVAL 1 DAY")).collect()}
    assert got == {("y", at(0), at(2000), at(1440)), ("z", at(2000), None, at(3440)), ("w", at(5), None, at(1445))}
    got = {(r.v, r.end) for r in intervals.validity_of_times(df, ["k"], "ts").collect()}
    assert got == {("x", at(2000)), ("y", at(2000)), ("z", None), ("w", None)}


def test_tags(spark):
    tags = spark.createDataFrame([(1, "open", at(0), None), (2, "back", at(10), at(5)), (3, "none", None, at(5)), (4, "past", at(-600), at(-500))], f"id long, name string, start_ts {NTZ}, end_ts {NTZ}")
    now = times.at(str(at(60)))
    assert {(r.id, r.end, r.ongoing, r.minutes) for r in intervals.tag_window(tags, now).collect()} == {(1, at(60), True, 60.0), (2, at(10), False, 0.0), (4, at(-500), False, 100.0)}
    series = spark.createDataFrame([(k, at(k)) for k in (-501, -500, -499, 0, 10, 60, 61)] + [(99, None)], f"k long, t {NTZ}")
    assert {(r.tag_id, r.k) for r in intervals.tagged(series, "t", tags, now).collect()} == {(4, -501), (4, -500), (1, 0), (1, 10), (1, 60), (2, 10)}
    events = spark.createDataFrame([("old", at(1)), ("old", at(9)), ("live", at(1)), (None, at(1)), ("", at(1)), ("open", at(2))], f"event string, ts {NTZ}")
    assert [(r.name, r.start_ts, r.end_ts) for r in intervals.tags_of_events(events, tags).collect()] == [("old", at(1), at(9))]


def test_figures_of_tags_equal_those_of_pairs(spark):
    """As `tagged` and a grouping, with ties, null times, entities and sources, windows of an instant; and in far fewer rows than pairs."""
    rng = random.Random(3)
    when = lambda: rng.choice([None, at(rng.randrange(300)), at(rng.random() * 3000), at(rng.randrange(-90, 90) * 40)])
    tags = spark.createDataFrame([(k, f"t{k}", when(), when()) for k in range(120)] + [(500, "x", at(5), at(5))], f"id long, name string, start_ts {NTZ}, end_ts {NTZ}")
    rows = [(k, when(), rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3, *range(60)]), rng.choice([None, 1.0, 2.5, float(k)])) for k in range(2500)]
    series = spark.createDataFrame(rows, f"seq long, t {NTZ}, source string, entity long, height double")
    now = times.at(str(at(2000)))
    pairs = intervals.tagged(series, "t", tags, now)
    want = pairs.groupBy("tag_id").agg(F.count("*").alias("n"), F.max("height").alias("peak"), F.max_by("seq", F.struct("height", "seq")).alias("top"))
    first = [F.count("*").alias("n"), F.max("height").alias("peak"), F.max(F.struct("height", "seq")).alias("top")]
    got = intervals.tagged_totals(series, "t", tags, now, first, [F.sum("n").alias("n"), F.max("peak").alias("peak"), F.max("top").alias("top")])
    assert {(r.tag_id, r.n, r.peak, r.top.seq) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 60
    want = pairs.groupBy("tag_id", "source").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))
    got = intervals.tagged_counts(series, "t", tags, now, ["source"], "entity")
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect())


def test_a_window_of_numbers_is_few_nodes(spark):
    rng = random.Random(5)
    spans = [(k, *sorted((rng.randrange(70_000), rng.randrange(70_000)))) for k in range(300)] + [(900, 0, 69_999), (901, 7, 7)]
    nodes = intervals._numbered_nodes(spark.createDataFrame(spans, "k long, _low long, _high long"), 4).collect()
    held = {}
    for r in nodes:
        held.setdefault(r.k, []).append((r.block * 16**r.level, (r.block + 1) * 16**r.level))
    for k, low, high in spans:
        parts = sorted(held[k])
        assert parts[0][0] == low and parts[-1][1] == high + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and len(parts) <= 5 * 30


def test_states_are_those_of_the_instant(spark):
    rows = [("fire", "a", 0, 1, 1, '{"status": "Going", "source": "shadow", "size": 2}'), ("fire", "a", 10, 1, 2, "no json"), ("fire", "a", 20, 0, 3, None), ("power", "b", 5, 1, 4, "{}"), ("power", "c", 5, 1, 5, None)]
    journal = spark.createDataFrame([(s, k, at(t), a, n, j, None if k == "b" else 1.0, None) for s, k, t, a, n, j in rows], f"source string, entity_key string, effective_ts {NTZ}, active int, seq long, state_json string, latitude double, longitude double")
    instants = spark.createDataFrame([(at(t),) for t in (-1, 0, 9, 10, 19, 20, 30)], f"at {NTZ}")
    rows = replay.expand_state(replay.states_at(journal, instants), "status string, source string, size double")
    assert rows.columns == ["at", *journal.columns, "status", "size"]
    got = {((r["at"] - T0).seconds // 60, r.entity_key, r.source, r.status, r["size"]) for r in rows.where("source = 'fire'").collect()}
    assert got == {(0, "a", "fire", "Going", 2.0), (9, "a", "fire", "Going", 2.0), (10, "a", "fire", None, None), (19, "a", "fire", None, None)}
    assert replay.states_at(journal, instants, include_inactive=True).where("active = 0").count() == 2
    cache = spark.createDataFrame([("b", 7.0, 8.0), ("c", 9.0, 9.0)], "location string, latitude double, longitude double")
    power = replay.filled(replay.states_at(journal, instants).where("source = 'power'"), cache).select("entity_key", "latitude", "longitude").distinct()
    assert {tuple(r) for r in power.collect()} == {("b", 7.0, 8.0), ("c", 1.0, None)}


def test_layers_forget_what_is_old(spark):
    instants = spark.createDataFrame([(at(t),) for t in (0, 20, 21, 1440, 1441)], f"at {NTZ}")
    minutes = lambda df: {((r["at"] - T0).total_seconds() // 60, r.k) for r in df.collect()}
    cells = spark.createDataFrame([("c", at(0), 1), ("c", at(0), 2), ("c", at(-1), 3)], f"cell_id string, ts {NTZ}, k long")
    assert minutes(replay.cells_at(cells, instants)) == {(0, 1), (0, 2), (20, 1), (20, 2)}
    gauges = spark.createDataFrame([("g", at(0), 1, 3.0, 1.0, 2.0, 3.0), ("h", at(0), 2, 1.0, None, None, None)], f"station string, ts {NTZ}, seq long, height double, minor double, moderate double, major double")
    places = spark.createDataFrame([("g", 1)], "station string, k long")
    rows = replay.gauges_at(gauges, places, instants)
    assert minutes(rows) == {(0, 1), (20, 1), (21, 1), (1440, 1)} and {r.priority for r in rows.collect()} == {1}
    aws = spark.createDataFrame([("w", at(0), 1), ("w", at(0), 2), ("w", at(25), 3)], f"wmo string, ts {NTZ}, k long")
    assert minutes(replay.weather_at(aws, spark.createDataFrame([("x", 1.0)], "wmo string, latitude double"), instants)) == {(0, 1), (0, 2), (20, 1), (20, 2), (21, 1), (21, 2), (1440, 3), (1441, 3)}


def test_rows_at_instants_are_few_after_the_first_shuffle(spark):
    """As the spans of validity that hold an instant, for keys with null parts, ties and instants off the rows' range; no row is taken apart."""
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", "c"]), rng.choice([1, 2, 3]), None if rng.random() < 0.1 else at(rng.randrange(0, 3000, 7)), k) for k in range(1500)]
    df = spark.createDataFrame(rows, f"s string, k long, ts {NTZ}, seq long")
    instants = spark.createDataFrame([(t,) for t in [at(m) for m in (-5, 0, 700, 701, 1500, 1500, 2999, 9000)] + [None]], f"at {NTZ}")
    age = F.expr("INTERVAL 1 DAY")
    for max_age in (None, age):
        want = intervals.stab(intervals.validity(df, ["s", "k"], "ts", "seq", max_age=max_age), instants.distinct()).select("at", *df.columns)
        got = replay.last_at(df, ["s", "k"], "ts", "seq", instants, max_age=max_age)
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect()) and got.count() > 20
        want = intervals.stab(intervals.validity_of_times(df, ["s", "k"], "ts", max_age=max_age), instants.distinct()).select("at", *df.columns)
        got = replay.last_times_at(df, ["s", "k"], "ts", instants, max_age=max_age)
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in want.collect())
