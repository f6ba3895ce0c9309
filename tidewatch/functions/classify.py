"""Classes, priorities and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flood classes by priority.
FLOOD = {1: "Major flooding", 2: "Moderate flooding", 3: "Minor flooding", 4: "Below flood level"}
#: Severities.
CRITICAL, MAJOR, NOTABLE, INFO = 3, 2, 1, 0
#: Order of warning levels; 1 is the gravest.
WARNING_ORDER = {"emergency warning": 1, "evacuate": 1, "evacuation": 1, "watch and act": 2, "advice": 3, "community information": 3}
#: Order of weather warning groups.
GROUP_ORDER = {"major": 1, "severe": 1, "moderate": 2, "minor": 3}
DURATIONS = [(360, "0-6 hours"), (1440, "6-24 hours"), (2880, "24-48 hours")]
POINTS_8 = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
POINTS_16 = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def lookup(c: Column, table: dict, default=None) -> Column:
    """A small fixed table as one expression."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(default))


def flood_priority(height: Column, minor: Column, moderate: Column, major: Column) -> Column:
    """1 major, 2 moderate, 3 minor, 4 below or unknown; a missing threshold is never reached."""
    return F.when(height >= major, 1).when(height >= moderate, 2).when(height >= minor, 3).otherwise(4)


def flood_label(priority: Column) -> Column:
    return lookup(priority, FLOOD)


def fire_priority(level: Column, category: Column) -> Column:
    """Warnings by level, then fires, then the rest."""
    order = lookup(F.lower(F.trim(level)), WARNING_ORDER)
    return F.coalesce(order, F.when(F.lower(category).contains("fire"), 4).otherwise(5))


def warning_order(level: Column) -> Column:
    return lookup(F.lower(F.trim(level)), WARNING_ORDER)


def map_kind(level: Column, category1: Column, category2: Column) -> Column:
    """What a warning is drawn as: evacuations as Emergency Warning, meteorological as Met, unknown as Advice."""
    low = F.lower(F.trim(level))
    met = (F.lower(category1) == "met") | (F.lower(category2) == "met")
    return F.when(met, "Met").when(low.isin("emergency warning", "evacuate", "evacuation"), "Emergency Warning").when(low == "watch and act", "Watch and Act").otherwise("Advice")


def is_met(category1: Column, category2: Column) -> Column:
    return F.coalesce(F.lower(category1) == "met", F.lit(False)) | F.coalesce(F.lower(category2) == "met", F.lit(False))


def group_priority(group: Column) -> Column:
    return lookup(F.lower(group), GROUP_ORDER, 4)


def storm_class(highest: Column, mean: Column) -> Column:
    return F.when((highest >= 12) | ((highest >= 10) & (mean >= 8)), "strong").when(highest >= 8, "moderate").otherwise("weak")


def is_closure(status: Column, access: Column, closed_road: Column, kind: Column, sub: Column) -> Column:
    """Whether a disruption shuts the road: a partial one doesn't; a named closed road, or the word, does."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    over = low(status).isin("reopened", "inactive")
    partial = low(access).rlike("partial|lane|reduced|shoulder")
    named = F.trim(F.coalesce(closed_road, F.lit(""))) != ""
    word = low(access).contains("clos") | F.concat(low(kind), low(sub)).contains("clos")
    return ~over & ~partial & (named | word)


def duration_bucket(minutes: Column) -> Column:
    out = F.when(minutes < DURATIONS[0][0], DURATIONS[0][1])
    for most, label in DURATIONS[1:]:
        out = out.when(minutes < most, label)
    return out.when(minutes.isNotNull(), "48+ hours")


def power_level(customers: Column, high: int = 20_000, low: int = 10_000) -> Column:
    return F.when(customers > high, "high").when(customers > low, "low").otherwise("normal")


def is_resolved(status: Column) -> Column:
    return F.coalesce(F.lower(F.trim(status)).isin("safe", "complete"), F.lit(False))


def trend_headline(rate: Column, accelerating: Column, least: float = 0.02, rapid: float = 0.25) -> Column:
    return F.when(rate <= -least, "Falling").when(rate < least, "Steady").when(rate >= rapid, "Rising rapidly").when(accelerating, "Rising, accelerating").otherwise("Rising")


def accel_label(recent: Column, earlier: Column, epsilon: Column) -> Column:
    change = recent - earlier
    return F.when(change.isNull(), "Unknown").when(change > epsilon, "Increasing").when(change < -epsilon, "Decreasing").otherwise("Steady")


def source_state(age: Column, interval: Column) -> Column:
    """never, stale (older than three intervals and ten minutes) or ok."""
    return F.when(age.isNull(), "never").when(age > F.greatest(F.lit(10.0), 3 * interval), "stale").otherwise("ok")


def lead_bucket(minutes: Column) -> Column:
    return F.when(minutes < 60, "0-60").when(minutes < 180, "60-180").when(minutes < 360, "180-360").when(minutes.isNotNull(), "360+")


def cardinal(bearing: Column, points: list[str] = POINTS_8) -> Column:
    """The compass point nearest to a bearing; null for null."""
    step = 360 / len(points)
    return F.element_at(F.array(*[F.lit(p) for p in points]), (F.pmod(F.floor(F.pmod(bearing, F.lit(360.0)) / step + 0.5), F.lit(len(points))) + 1).cast("int"))


def percent_change(before: Column, after: Column) -> Column:
    return 100 * F.try_divide(after - before, before)


def intensity(mean: Column, highest: Column, area: Column) -> Column:
    return 4 * mean + 2.5 * highest + F.least(area / 15, F.lit(20.0))


def marker_size(value: Column, scale: float, least: float, most: float) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.sqrt(value) * scale))
