"""What to announce between two looks at the same feeds: what is new, graver, over, and at first what holds already.

Every hazard gives its current alerts as (kind, key, priority, label), 1 being the gravest. Two looks are compared by key,
and each kind's changes become one message with its first labels and the number of the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import classify, text
from tidewatch.functions.classify import POINTS_8

ALERT = ["kind", "key", "priority", "label"]
#: How many labels a message lists, by kind.
LISTED = {"flood": 10, "fire": 10, "weather": 6, "storm": 6, "roads": 8}


def _alert(rows: DataFrame, kind: str, key: str, priority: Column, label: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), priority.cast("int").alias("priority"), label.alias("label")).where("key IS NOT NULL")


def flood(latest: DataFrame) -> DataFrame:
    """Gauges at or above a flood class. latest: station, height, minor, moderate, major."""
    rows = latest.withColumn("p", classify.flood_priority(F.col("height"), F.col("minor"), F.col("moderate"), F.col("major"))).where("p < 4")
    return _alert(rows, "flood", "station", F.col("p"), classify.flood_label(F.col("p")))


def fire(incidents: DataFrame, categories: list[str]) -> DataFrame:
    """Warnings, and incidents of some categories. incidents: source_id, feed_type, category1, warning_level, location, status."""
    warning = F.coalesce(F.col("feed_type") == "warning", F.lit(False))
    rows = incidents.where(warning | F.lower(F.trim("category1")).isin([c.strip().lower() for c in categories]))
    or_else = lambda c, word: F.coalesce(text.blank_to_null(F.col(c)), F.lit(word))
    label = F.when(warning, F.concat(or_else("warning_level", "Warning"), F.lit(" — "), or_else("location", "VIC"))).otherwise(F.concat("category1", F.lit(" at "), or_else("location", "unknown"), F.lit(" ("), or_else("status", "active"), F.lit(")")))
    return _alert(rows, "fire", "source_id", classify.fire_priority(F.col("warning_level"), F.col("category1")), label)


def weather(warnings: DataFrame) -> DataFrame:
    """Warnings: warning_id, group_type, type, title."""
    label = F.left(F.concat(text.pretty(F.coalesce("type", F.lit(""))), F.lit(": "), F.coalesce("title", F.lit(""))), F.lit(160))
    return _alert(warnings, "weather", "warning_id", classify.group_priority(F.col("group_type")), label)


def storm(cells: DataFrame) -> DataFrame:
    """Moderate and strong cells: cell_id, radar_id, classification, intensity_score, area_km2, speed_kmh, bearing_deg."""
    rows = cells.where("classification IN ('strong', 'moderate')")
    whole = lambda c: F.format_string("%.0f", F.col(c).cast("double"))
    moving = F.col("speed_kmh").isNotNull() & F.col("bearing_deg").isNotNull()
    movement = F.when(moving, F.concat(F.lit(", "), classify.cardinal(F.col("bearing_deg"), POINTS_8), F.lit(" "), whole("speed_kmh"), F.lit(" km/h"))).otherwise("")
    label = F.concat(F.upper("classification"), F.lit(" cell "), F.col("cell_id").cast("string"), F.lit(" on "), F.coalesce("radar_id", F.lit("radar")), F.lit(" (score "), whole("intensity_score"), F.lit(", ~"), whole("area_km2"), F.lit(" km²"), movement, F.lit(")"))
    return _alert(rows, "storm", "cell_id", F.when(F.col("classification") == "strong", 1).otherwise(2), label)


def roads(disruptions: DataFrame) -> DataFrame:
    """Full closures: source_id, road_name, location, disruption_type, is_closure."""
    road, place, kind = (text.blank_to_null(F.col(c)) for c in ("road_name", "location", "disruption_type"))
    label = F.concat(F.coalesce(road, place, F.lit("road")), F.coalesce(F.when(road.isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))), F.lit("")), F.coalesce(F.concat(F.lit(" — "), kind), F.lit("")))
    return _alert(disruptions.where("is_closure = 1"), "roads", "source_id", F.lit(1), label)


def _listed(rows: DataFrame, order: list[Column], most: Column, separator: str = "; ") -> DataFrame:
    """(kind, part, n, text): the first labels of each kind and part, and how many more there are."""
    keys = ["kind", "part"]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= most)
    joined = first.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), separator).alias("text"))
    more = F.col("n") - most
    both = joined.join(counted, keys)
    return both.select(*keys, "n", F.concat("text", F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise("")).alias("text"))


def _most() -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in LISTED.items()], F.lit(10))


def started(current: DataFrame) -> DataFrame:
    """(kind, part, n, text) of a first look: how many alerts hold, with the worst; strong cells alone of storms; closures are listed."""
    worst = current.where("kind IN ('flood', 'fire', 'weather')").groupBy("kind").agg(F.count("*").alias("n"), F.min(F.struct("priority", "label")).alias("w"))
    worst = worst.select("kind", F.lit("started").alias("part"), "n", F.concat(F.lit("worst: "), "w.label").alias("text"))
    rows = current.where("(kind = 'storm' AND priority = 1) OR kind = 'roads'").withColumn("part", F.lit("started"))
    return worst.unionByName(_listed(rows, [F.when(F.col("kind") == "storm", F.col("label")), F.col("key")], F.lit(5)))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, part, n, text) between two looks: escalated (new, or of a smaller priority) and cleared alerts.

    Floods are listed by name and named; of weather and of strong storm cells that are over only the number is told.
    """
    old = before.select("kind", "key", F.struct("priority", "label").alias("o"))
    both = old.join(after.select("kind", "key", F.struct("priority", "label").alias("a")), ["kind", "key"], "full_outer")
    up = F.col("a").isNotNull() & (F.col("o").isNull() | (F.col("a.priority") < F.col("o.priority")))
    over = F.col("a").isNull() & ((F.col("kind") != "storm") | (F.col("o.priority") == 1))
    rows = both.withColumn("part", F.when(up, "escalated").when(over, "cleared")).where("part IS NOT NULL").select("kind", "part", "key", F.coalesce("a.priority", "o.priority").alias("priority"), F.coalesce("a.label", "o.label").alias("label"))
    gone = (F.col("kind") == "flood") & (F.col("part") == "cleared")
    named = F.when(gone, F.col("key")).when(F.col("kind") == "flood", F.concat("key", F.lit(": "), "label")).otherwise(F.col("label"))
    by_key = F.col("kind").isin("flood", "roads")
    told = _listed(rows.withColumn("label", named), [F.when(~by_key, F.col("priority")), F.when(~by_key, F.col("label")), F.col("key")], _most())
    silent = F.col("kind").isin("weather", "storm") & (F.col("part") == "cleared")
    return told.withColumn("text", F.when(~silent, F.col("text")))


def power(before: Column, after: Column) -> Column:
    """The message of a change of the power level between two totals of customers off (null before: the first look); null without one."""
    was, now = classify.power_level(before), classify.power_level(after)
    n = F.format_number(after, 0)
    first = F.when(now != "normal", F.concat(F.lit("Monitor started — power is at "), F.upper(now), F.lit(" alert: "), n, F.lit(" customers off supply.")))
    later = F.when(now == "high", F.concat(F.lit("High alert — "), n, F.lit(" customers off supply."))).when(now == "low", F.concat(F.lit("Low alert — "), n, F.lit(" customers off supply."))).otherwise(F.concat(F.lit("Power recovered to normal — "), n, F.lit(" customers off supply.")))
    return F.when(after.isNull(), None).when(before.isNull(), first).when(was != now, later)


def all_alerts(*kinds: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, kinds).select(ALERT)


def incident_log(incidents: DataFrame, seen: DataFrame | None, limit: int = 14) -> DataFrame:
    """(ident, first_seen, item, new): the latest incidents that are neither warnings nor burnt areas, and which weren't listed before.

    incidents: source_id, seq, feed_type, category1, location, first_seen; seen: ident, None at the first look, when nothing is new.
    """
    rows = incidents.where("feed_type NOT IN ('warning', 'burn-area')").orderBy(F.desc_nulls_last("first_seen"), F.desc("seq")).limit(limit)
    made = F.concat_ws("|", F.coalesce(F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"), F.lit("None")), F.coalesce("location", F.lit("None")), F.coalesce("category1", F.lit("None")))
    item = F.concat(F.coalesce(text.blank_to_null(F.col("category1")), F.lit("Incident")), F.lit(" — "), F.coalesce(text.blank_to_null(F.col("location")), F.lit("unknown")))
    rows = rows.select(F.coalesce(F.nullif(F.col("source_id").cast("string"), F.lit("")), made).alias("ident"), "first_seen", item.alias("item"))
    if seen is None:
        return rows.withColumn("new", F.lit(False))
    return rows.join(seen.select("ident").distinct().withColumn("_old", F.lit(True)), "ident", "left").select("ident", "first_seen", "item", F.col("_old").isNull().alias("new"))
