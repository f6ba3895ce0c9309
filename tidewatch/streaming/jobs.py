"""Streams: file feeds into idempotent tables, and state by key where a batch can't hold it."""

from __future__ import annotations

import hashlib
from collections import namedtuple
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators import changes, temporal
from tidewatch.operators.changes import new_rows
from tidewatch.operators.spatial import TRACKS, Tracker
from tidewatch.streaming.buckets import Buckets


def insert_once(path: str, keys: list[str], seq: str, *, writer: str = "main", buckets: int = 64, folders: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends rows whose key isn't stored; repeats, late rows and retried batches do no harm.

    Rows come at any lateness, so they are compared with the table rather than dropped behind a watermark, with the buckets
    of their own keys only. A retried batch overwrites its folder, rows with null keys included; streams that fill one
    table need names of their own (`writer`). The table is compacted when it has grown by so many folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = Buckets(batch.sparkSession, path, _ddl(batch), keys, buckets)
        batch = batch.persist()
        try:
            own = table.folder(writer, number)
            table.write(new_rows(table.read(table.of(batch), without=own), batch, keys, seq), own)
        finally:
            batch.unpersist()
        if len(table.live()) > folders:
            table.compact()

    return write


def ingest(source: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str) -> StreamingQuery:
    """Run what is available of a stream of typed rows into the table at path; a checkpoint is a writer of its own."""
    writer = hashlib.sha1(checkpoint.encode()).hexdigest()[:12]
    return source.writeStream.foreachBatch(insert_once(path, keys, seq, writer=writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_changes(path: str, *, complete: bool = True, tombstone_time: str = "source", writer: str = "main", buckets: int = 64, folders: int = 50) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends to a journal what a poll changed: new states, and the end of what is absent.

    A batch is one poll of (source, entity_key, effective_ts, state, state_hash, seq); sources that it doesn't mention are
    left alone. The journal grows without end and isn't read: the last row of every entity is kept beside it, in buckets
    by source (by entity, if polls aren't complete), and a poll reads those of its own only. A retried batch writes what it
    wrote before.
    """
    by = ["source"] if complete else ["source", "entity_key"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            schema = f"{_ddl(batch)}, active int"
            journal, last = (Buckets(spark, p, schema, by, buckets) for p in (path, f"{path}/_last"))
            own = last.folder(writer, number)
            now = F.lit(batch.agg(F.max("effective_ts")).first()[0]).cast("timestamp_ntz")
            known = last.read(last.of(batch), without=own)
            rows = changes.journal_batch(known, batch, now, complete=complete, tombstone_time=tombstone_time).select(known.columns).persist()
            last.write(rows, own)
            journal.write(rows, own)
            rows.unpersist()
        finally:
            batch.unpersist()
        if len(last.live()) > folders:
            last.compact(lambda rows: temporal.latest(rows, ["source", "entity_key"], ["effective_ts", "seq"]).select(rows.columns))

    return write


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that is written anew with each batch, the newest last; those that weren't finished don't count."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    there = [f.getPath() for f in fs.listStatus(hadoop) if f.getPath().getName().startswith("v=")]
    return sorted(int(p.getName()[2:]) for p in there if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, path: str, schema, *, before: int | None = None) -> DataFrame:
    """A versioned table's rows as of its newest version, or the newest one before a version; none where there is none."""
    made = [v for v in versions(spark, path) if before is None or v < before]
    return spark.read.schema(schema).parquet(f"{path}/v={made[-1]}") if made else spark.createDataFrame([], schema)


def merge_polls(path: str, key: str, ts: str, *, alerts: str | None = None, priority: str | None = None, empty_means_none: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps a table of entities: a poll's rows replace or join the stored ones, absent ones are resolved.

    A batch is one poll. The table is written anew as a version of the batch's number, from the version before it, so a
    retried batch writes what it wrote before. With `alerts`, what is new, cleared, escalated and eased by `priority` among
    open entities is written there in a folder of its own for each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            schema = f"{_ddl(batch)}, first_seen timestamp_ntz, last_seen timestamp_ntz, resolved int"
            old = current(spark, path, schema, before=number)
            now = F.lit(batch.agg(F.max(ts)).first()[0]).cast("timestamp_ntz")
            merged = changes.upsert(old.drop("resolved"), batch, key, now)
            known = old.select(key, F.col("resolved").alias("_was"))
            came = batch.select(key, F.lit(0).alias("_now"))
            table = merged.join(known, key, "left").join(came, key, "left").withColumn("resolved", F.coalesce("_now", "_was", F.lit(0))).drop("_was", "_now")
            swept = changes.sweep(table, batch, key, F.coalesce(now, F.col("last_seen")), empty_means_none=empty_means_none)
            names = [f.split()[0] for f in schema.split(", ")]
            swept.select(names).write.mode("overwrite").parquet(f"{path}/v={number}")
            if alerts:
                open_ = lambda df: df.where("resolved = 0")
                after = current(spark, path, schema, before=number + 1)
                changes.snapshot_diff(open_(old), open_(after), key, priority).write.mode("overwrite").parquet(f"{alerts}/v={number}")
        finally:
            batch.unpersist()

    return write


def run_batches(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run what is available of a stream through a foreachBatch function."""
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_cells(stream: DataFrame, km_per_px: float = 1.0) -> DataFrame:
    """TRACKS of detections (radar_id, ts, det, x, y, area), as cell_tracks gives them: a radar's tracker is its state.

    Frames come whole and in order; one that isn't later than the last of its radar has been followed already and is
    left out.
    """
    import pickle

    import pandas as pd

    names = [f.split()[0] for f in TRACKS.split(", ")]

    def run(key, frames, state: GroupState):
        tracker, last = pickle.loads(state.get[0]) if state.exists else (Tracker(), None)
        out = []
        for ts, frame in pd.concat(list(frames)).sort_values(["ts", "det"]).groupby("ts", sort=True):
            if last is not None and ts <= last:
                continue
            made = tracker.step(ts.timestamp(), list(frame[["x", "y", "area"]].itertuples(index=False, name=None)), km_per_px)
            out += [(key[0], ts, int(d), *m) for d, m in zip(frame.det, made, strict=True)]
            last = ts
        state.update((pickle.dumps((tracker, last)),))
        yield pd.DataFrame(out, columns=names).astype({"speed_kmh": "float64", "bearing": "float64"})

    rows = stream.where("radar_id IS NOT NULL AND ts IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND area IS NOT NULL").select("radar_id", "ts", F.col("det").cast("long").alias("det"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "area")])
    return rows.groupBy("radar_id").applyInPandasWithState(run, TRACKS, "tracker binary", "append", GroupStateTimeout.NoTimeout)


def cell_alerts(stream: DataFrame, forget_minutes: int = 30) -> DataFrame:
    """(cell_id, ts, alert_type, classification) where a cell (cell_id, ts, classification) is graver than ever; cells are forgotten some minutes after their last frame."""
    import pandas as pd

    grade = {"strong": 1, "moderate": 2}

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        best, last = state.get if state.exists else (None, 0.0)
        out = []
        for ts, name in pd.concat(list(frames)).sort_values("ts")[["ts", "classification"]].itertuples(index=False, name=None):
            last = max(last, ts.timestamp())
            if name in grade and (best is None or grade[name] < best):
                out.append((key[0], ts, "new_cell" if best is None else "escalation", name))
                best = grade[name]
        state.update((best, last))
        state.setTimeoutTimestamp(max(int(last * 1000) + forget_minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["cell_id", "ts", "alert_type", "classification"])

    rows = stream.select("cell_id", F.col("ts").cast("timestamp").alias("ts"), "classification").withWatermark("ts", f"{forget_minutes} minutes")
    return rows.groupBy("cell_id").applyInPandasWithState(run, "cell_id string, ts timestamp, alert_type string, classification string", "best int, last double", "append", GroupStateTimeout.EventTimeTimeout)


CHANGES = "hazard string, entity_key string, ts timestamp, value double, before double"


def metric_changes(stream: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Changes of a metric (hazard, entity_key, ts, value) in order of arrival by (ts): the last value is the state of its key.

    The first value of a key is a change from nothing. What arrives after a later batch was compared is compared with
    that batch's value.
    """
    import pandas as pd

    def run(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for ts, value in pd.concat(list(frames)).sort_values("ts")[["ts", "value"]].itertuples(index=False, name=None):
            if last is None or abs(value - last) > tolerance:
                out.append((*key, ts, value, last))
                last = value
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["hazard", "entity_key", "ts", "value", "before"]).astype({"before": "float64"})

    rows = stream.select("hazard", "entity_key", F.col("ts").cast("timestamp").alias("ts"), "value").where("value IS NOT NULL")
    return rows.groupBy("hazard", "entity_key").applyInPandasWithState(run, CHANGES, "last double", "append", GroupStateTimeout.NoTimeout)


def suppress_repeats(stream: DataFrame, minutes: int = 30) -> DataFrame:
    """Alerts (hazard, entity_key, kind, ts) that don't come within so many minutes after the last one shown; keys are forgotten after that."""
    import pandas as pd

    keys = ["hazard", "entity_key", "kind"]

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for ts in pd.concat(list(frames)).sort_values("ts")["ts"]:
            now = ts.timestamp()
            if last is None or now - last > minutes * 60:
                out.append((*key, ts))
                last = now
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last * 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "ts"])

    rows = stream.select(*keys, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", f"{minutes} minutes")
    return rows.groupBy(*keys).applyInPandasWithState(run, "hazard string, entity_key string, kind string, ts timestamp", "last double", "append", GroupStateTimeout.EventTimeTimeout)


def hourly_counts(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type, once no more can come."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


_Open = namedtuple("_Open", "station ts seq height id current target eta_point eta_early eta_late")  # noqa: PYI024
SETTLED = "id long, station string, outcome string, actual_ts timestamp, error_minutes double, within_range int"


def settle_projections(stream: DataFrame, *, grace_h: float = 3.0, late: str = "1 hour") -> DataFrame:
    """SETTLED rows of projections as they fall due, as `trend.settle` gives them in the end.

    stream: station, ts, seq and height of readings, and of projections ts (when they were observed), id, current, target,
    eta_point, eta_early, eta_late, which are null in readings. A gauge's state is its open projections, and its readings
    since the first of them or within an hour of the last. A reading at the target settles a projection when it comes, the
    watermark when its deadline is over; what comes later than that changes nothing.
    """
    import pickle

    import pandas as pd

    grace, hour = pd.Timedelta(hours=grace_h), pd.Timedelta(hours=1)
    names = [f.split()[0] for f in SETTLED.split(", ")]

    def run(key, frames, state: GroupState):
        open_, seen = pickle.loads(state.get[0]) if state.exists else ([], [])
        rows = [] if state.hasTimedOut else list(pd.concat(list(frames)).itertuples(index=False))
        open_ += [r for r in rows if not pd.isna(r.id)]
        seen = sorted(seen + [(r.ts, r.seq, r.height) for r in rows if pd.isna(r.id) and not pd.isna(r.height)])
        now = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")
        out, rest = [], []
        for p in open_:
            due = p.eta_late + grace
            after = [(ts, h) for ts, _, h in seen if p.ts < ts <= due]
            hit = next((ts for ts, h in after if h >= p.target), None)
            if hit is not None:
                out.append((int(p.id), key[0], "reached", hit, (hit - p.eta_point).total_seconds() / 60, int(p.eta_early <= hit <= p.eta_late)))
            elif now >= due:
                out.append((int(p.id), key[0], "receded" if after and after[-1][1] < p.current else "not_reached", None, None, 0))
            else:
                rest.append(p)
        if seen:
            first = min([p.ts for p in rest] + [seen[-1][0] - hour])
            seen = [r for r in seen if r[0] > first]
        if rest:
            state.update((pickle.dumps(([_Open(*p) for p in rest], seen)),))
            state.setTimeoutTimestamp(max(int(min(p.eta_late + grace for p in rest).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        elif seen:
            state.update((pickle.dumps(([], seen)),))
            state.setTimeoutTimestamp(max(int((seen[-1][0] + hour).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if state.hasTimedOut and not rest and state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names).astype({"actual_ts": "datetime64[ns]", "error_minutes": "float64"})

    times = [F.col(c).cast("timestamp").alias(c) for c in ("ts", "eta_point", "eta_early", "eta_late")]
    rows = stream.select(F.col("station").cast("string").alias("station"), times[0], F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.col("height").cast("double").alias("height"), F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("current", "target")], *times[1:])
    rows = rows.where("station IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("station").applyInPandasWithState(run, SETTLED, "held binary", "append", GroupStateTimeout.EventTimeTimeout)
