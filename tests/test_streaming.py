"""Streams give what batches give."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from tidewatch.operators import spatial
from tidewatch.operators.changes import journal_rows
from tidewatch.streaming import buckets, jobs


def split_files(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 2 == k % 2).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_ingest_is_idempotent(spark, sf, tmp_path):
    events, stream = split_files(spark, sf, tmp_path)
    out = str(tmp_path / "table")
    jobs.ingest(stream, out, ["event_id"], "event_id", str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(out).count() == events.count()
    jobs.ingest(stream, out, ["event_id"], "event_id", str(tmp_path / "c2")).awaitTermination(120)  # all again
    assert sorted(spark.read.parquet(out).select("event_id").collect()) == sorted(events.select("event_id").collect())


def tree(path):
    return sorted(str(p.relative_to(path).parent) for p in path.rglob("part-*.parquet"))


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    schema = "k long, v string, seq long"
    path = tmp_path / "table"
    write = jobs.insert_once(str(path), ["k"], "seq", buckets=16, folders=3)
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    write(batch(*[(k, "a", k) for k in range(100)], (None, "n", 1), (None, "n", 1)), 0)
    write(batch((5, "b", 1), (200, "b", 2), (200, "c", 3), (None, "m", 1)), 1)
    write(batch((5, "b", 1), (200, "b", 2), (200, "c", 3), (None, "m", 1)), 1)  # a retried batch
    table = buckets.Buckets(spark, str(path), schema, ["k"], 16)
    rows = lambda: sorted((r.k is None, r.k or 0, r.v) for r in table.read().collect())
    want = sorted([(False, k, "a") for k in range(100)] + [(True, 0, "n")] * 2 + [(False, 200, "b"), (True, 0, "m")])
    assert rows() == want
    one = table.of(batch((200, "x", 0)))
    assert len(one) == 1
    plan = table.read(one)._jdf.queryExecution().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scanned = {f.split("bucket=")[1].split("/")[0] for f in table.read(one).select("k", F.input_file_name().alias("f")).toPandas()["f"]}
    assert scanned == {str(one[0])}
    for n in (2, 3):
        write(batch((300 + n, "c", 1), (5, "z", 1)), n)
    assert table.live() == ["writer=_base/batch=0"] and rows() == sorted([*want, (False, 302, "c"), (False, 303, "c")])
    write(batch((5, "z", 1), (301, "d", 1)), 4)
    table.compact(sweep=True)
    assert rows() == sorted([*want, (False, 302, "c"), (False, 303, "c"), (False, 301, "d")]) and len({x.split("/bucket")[0] for x in tree(path) if "_manifests" not in x}) == 1


def test_an_unfinished_compaction_does_not_count(spark, tmp_path):
    table = buckets.Buckets(spark, str(tmp_path / "t"), "k long", ["k"], 4)
    assert table.read().count() == 0
    table.write(spark.range(10).withColumnRenamed("id", "k"), table.folder("w", 0))
    table.write(table.read(), "writer=_base/batch=0")  # as it stands before its manifest
    assert table.read().count() == 10
    table.compact()
    assert table.live() == ["writer=_base/batch=0"] and table.read().count() == 10


def test_the_journal_keeps_its_last_states(spark, tmp_path):
    schema = "source string, entity_key string, effective_ts timestamp_ntz, state string, state_hash string, seq long"
    path = str(tmp_path / "journal")
    write = jobs.write_changes(path, folders=2, buckets=8)
    t0 = dt.datetime(2026, 8, 11, 12)
    rng = random.Random(5)
    want, last = [], {}
    for n in range(6):
        now = t0 + dt.timedelta(minutes=n)
        poll = {(s, str(k)): rng.choice("xy") for s in rng.sample(["fire", "roads", "power"], 2) for k in range(5) if rng.random() < 0.7}
        write(spark.createDataFrame([(s, k, now, v, v, 10 * n) for (s, k), v in poll.items()], schema), n)
        for key in set(last) | set(poll):
            if key in poll and last.get(key) != poll[key]:
                want.append((*key, poll[key], 1))
                last[key] = poll[key]
            elif key not in poll and last.get(key) and key[0] in {s for s, _ in poll}:
                want.append((*key, last[key], 0))
                last[key] = None
        assert sorted((r.source, r.entity_key, r.state, r.active) for r in spark.read.parquet(path).collect()) == sorted(want)
    assert any("_base" in str(p) for p in (tmp_path / "journal" / "_last").rglob("*.parquet"))


def memory(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_metric_changes_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    rows = events.select(F.col("event_type").alias("hazard"), F.lit("all").alias("entity_key"), "ts", F.floor(F.col("value") / 50).cast("double").alias("value"), "event_id")
    rows.drop("event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.drop("event_id").schema).parquet(str(tmp_path / "in"))
    got = memory(jobs.metric_changes(stream), "metric_changes", tmp_path)
    want = journal_rows(rows, ["hazard", "entity_key"], "ts", "event_id", "value")
    assert sorted((r.hazard, r.value, r.before) for r in got.where("before IS NOT NULL").collect()) == sorted((r.hazard, r.value, r.prev_value) for r in want.where("prev_value IS NOT NULL").collect())


def test_suppression(spark, tmp_path):
    stamps = ["10:00", "10:10", "10:50", "12:00", "12:20", "12:40", "13:00"]
    rows = spark.createDataFrame([("fire", "a", "rise", f"2024-01-01 {t}") for t in stamps], "hazard string, entity_key string, kind string, t string").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = memory(jobs.suppress_repeats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))), "suppressed", tmp_path)
    assert sorted(r.ts.strftime("%H:%M") for r in got.collect()) == ["10:00", "10:50", "12:00", "12:40"]


def test_hourly_counts_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    far = events.limit(1).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))  # so that all other hours are over
    events.unionByName(far).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = memory(jobs.hourly_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))), "hourly", tmp_path)
    want = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def polls(spark, tmp_path, schema, batches):
    """A stream with one file, and so one batch, for each poll."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))
        time.sleep(0.05)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls"))


def test_journal_of_polls(spark, tmp_path):
    t = [dt.datetime(2026, 8, 11, 12, 5 * k) for k in range(4)]
    row = lambda k, key, state: ("fire", key, t[k], state, f"h-{state}", 10 * k)
    batches = [[row(0, "a", "x"), row(0, "b", "x")], [row(1, "a", "x"), row(1, "b", "y")], [row(2, "b", "y")], [row(3, "a", "x"), row(3, "b", "y")]]
    schema = "source string, entity_key string, effective_ts timestamp_ntz, state string, state_hash string, seq long"
    stream, out = polls(spark, tmp_path, schema, batches), str(tmp_path / "journal")
    write = jobs.write_changes(out, tombstone_time="recorded")
    jobs.run_batches(stream, write, str(tmp_path / "c")).awaitTermination(120)
    rows = lambda: sorted((r.entity_key, r.effective_ts, r.state, r.active) for r in spark.read.parquet(out).collect())
    want = [("a", t[0], "x", 1), ("a", t[2], "x", 0), ("a", t[3], "x", 1), ("b", t[0], "x", 1), ("b", t[1], "y", 1)]
    assert rows() == want
    write(spark.createDataFrame(batches[3], schema), 3)  # a retried batch
    assert rows() == want


def test_merged_polls_and_alerts(spark, tmp_path):
    t = [dt.datetime(2026, 8, 11, 12, 5 * k) for k in range(4)]
    batches = [[("a", 2, t[0]), ("b", 3, t[0])], [("a", 1, t[1])], [("a", 1, t[2]), ("b", 3, t[2]), ("c", 2, t[2])]]
    schema = "id string, level int, seen timestamp_ntz"
    stream, table, alerts = polls(spark, tmp_path, schema, batches), str(tmp_path / "table"), str(tmp_path / "alerts")
    write = jobs.merge_polls(table, "id", "seen", alerts=alerts, priority="level")
    jobs.run_batches(stream, write, str(tmp_path / "c")).awaitTermination(120)
    full = f"{schema}, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved int"
    rows = lambda before=None: sorted((r.id, r.level, r.first_seen, r.last_seen, r.resolved) for r in jobs.current(spark, table, full, before=before).collect())
    assert jobs.versions(spark, table) == [0, 1, 2]
    assert rows(2) == [("a", 1, t[0], t[1], 0), ("b", 3, t[0], t[1], 1)]
    assert rows() == [("a", 1, t[0], t[2], 0), ("b", 3, t[0], t[2], 0), ("c", 2, t[2], t[2], 0)]
    told = lambda v: sorted((r.id, r.change) for r in spark.read.parquet(f"{alerts}/v={v}").collect())
    assert [told(v) for v in range(3)] == [[("a", "new"), ("b", "new")], [("a", "escalated"), ("b", "cleared")], [("b", "new"), ("c", "new")]]
    write(spark.createDataFrame(batches[2], schema), 2)  # a retried batch
    assert rows()[0] == ("a", 1, t[0], t[2], 0) and told(2) == [("b", "new"), ("c", "new")]
    write(spark.createDataFrame([], schema), 3)  # a feed that failed resolves nothing
    assert [r[4] for r in rows()] == [0, 0, 0]


def test_cells_followed_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    t0 = dt.datetime(2026, 8, 11, 12)
    frames = [[(radar, t0 + dt.timedelta(minutes=10 * k), 10 * k + d, 60.0 * d + 3 * k + rng.random(), 40.0, 30.0) for radar in "ab" for d in range(3)] for k in range(4)]
    schema = "radar_id string, ts timestamp_ntz, det long, x double, y double, area double"
    stream = polls(spark, tmp_path, schema, frames)
    facts = lambda df: sorted((r.radar_id, r.det, r.cell, r.speed_kmh and round(r.speed_kmh, 6), r.status) for r in df.collect())
    assert facts(memory(jobs.follow_cells(stream), "cells", tmp_path)) == facts(spatial.cell_tracks(spark.createDataFrame(sum(frames, []), schema)))


def test_cell_alerts(spark, tmp_path):
    t = [dt.datetime(2026, 8, 11, 12, 5 * k) for k in range(4)]
    batches = [[("a", t[0], "weak"), ("b", t[0], "strong")], [("a", t[1], "moderate"), ("b", t[1], "moderate")], [("a", t[2], "strong")], [("a", t[3], "strong")]]
    got = memory(jobs.cell_alerts(polls(spark, tmp_path, "cell_id string, ts timestamp_ntz, classification string", batches)), "cell_alerts", tmp_path)
    assert sorted((r.cell_id, r.ts, r.alert_type) for r in got.collect()) == [("a", t[1], "new_cell"), ("a", t[2], "escalation"), ("b", t[0], "new_cell")]
