"""Layers of the map as they stood, at any number of instants in one pass.

The instants cut time into slots. Of each key and slot only what was recorded last counts, which partial aggregation finds
before any shuffle, and it holds at the slot's instant and the next ones until the key's next slot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import classify
from tidewatch.operators.temporal import latest

STALE = "INTERVAL 24 HOURS"
STORM_ACTIVE = "INTERVAL 20 MINUTES"
FRAME = ["at", "layer", "entity_key", "label", "value", "latitude", "longitude"]


def expand_state(rows: DataFrame, schema: str, *, state: str = "state_json") -> DataFrame:
    """rows with the fields of their state as columns; a field named like a column of rows is left out, a state that isn't JSON gives nulls."""
    fields = F.from_json(F.col(state), schema)
    names = [f.split()[0] for f in schema.split(", ")]
    taken = {c.lower() for c in rows.columns}
    return rows.withColumn("_state", fields).select(*rows.columns, *[F.col(f"_state.{c}").alias(c) for c in names if c.lower() not in taken])


def _slots(rows: DataFrame, ts: str, instants: DataFrame) -> DataFrame:
    """rows with _ats, the instants in order (a short list, which goes to every task), and _slot, the first of them (from 0) not before the row's time."""
    listed = instants.where("at IS NOT NULL").agg(F.sort_array(F.collect_set("at")).alias("_ats"))
    rows = rows.where(F.col(ts).isNotNull()).crossJoin(F.broadcast(listed)).where(F.col(ts) <= F.array_max("_ats"))
    return rows.withColumn("_slot", F.size(F.filter("_ats", lambda x: x < F.col(ts))))


def _held(last: DataFrame, keys: list[str], ts: str, max_age: Column | None) -> DataFrame:
    """last (one row for each of the keys and _slot, with _ats) once for each instant, as `at`, from its slot until the key's next one, but not after max_age."""
    after = F.lead("_slot").over(Window.partitionBy(*keys).orderBy("_slot"))
    rows = last.withColumn("_after", F.coalesce(after, F.size("_ats")))
    rows = rows.withColumn("at", F.explode(F.slice("_ats", F.col("_slot") + 1, F.col("_after") - F.col("_slot")))).drop("_ats", "_after")
    return rows if max_age is None else rows.where(F.col("at") <= F.col(ts) + max_age)


def last_at(rows: DataFrame, keys: list[str], ts: str, seq: str, instants: DataFrame, *, max_age: Column | None = None) -> DataFrame:
    """at and rows: the last row by (ts, seq) of each key at each instant, no older than max_age (an interval)."""
    slots = _slots(rows, ts, instants)
    return _held(latest(slots, [*keys, "_slot", "_ats"], [ts, seq]), keys, ts, max_age).select("at", *rows.columns)


def last_times_at(rows: DataFrame, keys: list[str], ts: str, instants: DataFrame, *, max_age: Column | None = None) -> DataFrame:
    """As `last_at`, but all rows of a key's latest time."""
    slots = _slots(rows, ts, instants)
    tops = _held(slots.groupBy(*keys, "_slot", "_ats").agg(F.max(ts).alias(ts)), keys, ts, max_age)
    return rows.join(tops.select(*keys, ts, "at"), [*keys, ts]).select("at", *rows.columns)


def states_at(journal: DataFrame, instants: DataFrame, *, include_inactive: bool = False) -> DataFrame:
    """Every entity's state at each instant: at and the columns of a journal (source, entity_key, effective_ts, active, seq and more)."""
    rows = last_at(journal, ["source", "entity_key"], "effective_ts", "seq", instants)
    return rows if include_inactive else rows.where("active = 1")


def filled(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows (entity_key, latitude, longitude) whose missing latitude is taken, with its longitude, from a cache (location, latitude, longitude)."""
    known = cache.select(F.col("location").alias("entity_key"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    gone = F.col("latitude").isNull() & F.col("_lat").isNotNull()
    out = rows.join(known, "entity_key", "left")
    return out.withColumns({"latitude": F.when(gone, F.col("_lat")).otherwise(F.col("latitude")), "longitude": F.when(gone, F.col("_lon")).otherwise(F.col("longitude"))}).select(rows.columns)


def gauges_at(readings: DataFrame, places: DataFrame, instants: DataFrame) -> DataFrame:
    """Gauges with a place, by their last reading of the 24 hours before each instant, with priority. readings: station, ts, seq, height, minor, moderate, major."""
    rows = last_at(readings, ["station"], "ts", "seq", instants, max_age=F.expr(STALE)).join(places, "station")
    return rows.withColumn("priority", classify.flood_priority(F.col("height"), F.col("minor"), F.col("moderate"), F.col("major"))).select("at", "station", "height", "priority", *[c for c in places.columns if c != "station"])


def cells_at(cells: DataFrame, instants: DataFrame) -> DataFrame:
    """Each storm cell's rows of its last frame, if that was within the 20 minutes before an instant. cells: cell_id, ts and more."""
    return last_times_at(cells, ["cell_id"], "ts", instants, max_age=F.expr(STORM_ACTIVE))


def weather_at(readings: DataFrame, places: DataFrame, instants: DataFrame) -> DataFrame:
    """Each weather station's rows of its last time within 24 hours; its place is null if unknown. readings: wmo, ts and more."""
    return last_times_at(readings, ["wmo"], "ts", instants, max_age=F.expr(STALE)).join(places, "wmo", "left")


def frame(rows: DataFrame, layer: str | Column, key: str, label: Column, value: Column, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A layer's rows in the one shape of all layers."""
    return rows.select("at", (F.lit(layer) if isinstance(layer, str) else layer).alias("layer"), F.col(key).cast("string").alias("entity_key"), label.cast("string").alias("label"), value.cast("double").alias("value"), F.col(lat).cast("double").alias("latitude"), F.col(lon).cast("double").alias("longitude"))


def frames(layers: list[DataFrame]) -> DataFrame:
    """All layers' frames, one below the other."""
    return reduce(DataFrame.unionByName, layers).select(FRAME)
