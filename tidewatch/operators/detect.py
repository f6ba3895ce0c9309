"""Detectors: what in the histories of feeds is worth an entry, as rows of one shape.

Inputs are histories: a row for each time an entity was seen. A metric's recorded values are those that differ from the
one before, so an entry compares two recorded values and says since when the former held. Every detector takes the
cutoff from which entries count; none reads the clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify, text
from tidewatch.functions.shared import written
from tidewatch.functions.classify import CRITICAL, INFO, MAJOR, NOTABLE
from tidewatch.operators import changes, folds, temporal

EVENT = ["hazard", "kind", "severity", "headline", "ts", "entity_key", "entity_name", "metric", "prev_value", "new_value", "prev_label", "new_label", "since"]
#: What makes two entries the same.
EVENT_KEY = ["hazard", "entity_key", "metric", "kind", "ts"]


def recorded(polls: DataFrame, key: str, value: str, label: str | None = None, *, ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows of polls at which a metric's value changed, with prev_value, prev_label and since; a key's first has none.

    Rows without a key, a time or a value are no readings.
    """
    rows = polls.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    rows = rows.withColumns({"_value": F.col(value), "_label": F.col(label) if label else F.lit(None).cast("string"), "_since": F.col(ts)})
    steps = changes.journal_rows(rows, [key], ts, seq, "_value").drop("prev__value", f"prev_{seq}")
    named = {"prev__value": "prev_value", "prev__label": "prev_label", "prev__since": "since"}
    return temporal.with_previous(steps, [key], ts, seq, ["_value", "_label", "_since"]).withColumnsRenamed(named).drop("_value", "_label", "_since")


def _entries(rows: DataFrame, hazard: str, metric: str, **columns: Column) -> DataFrame:
    """rows as EVENT, what isn't given as nulls."""
    null = {"prev_value": "double", "new_value": "double", "prev_label": "string", "new_label": "string", "since": "timestamp_ntz", "entity_name": "string"}
    fixed = {"hazard": F.lit(hazard), "metric": F.lit(metric)} | {k: F.lit(None).cast(t) for k, t in null.items()} | columns
    casts = {"severity": "int", "entity_key": "string", "prev_value": "double", "new_value": "double"}
    return rows.select(*[(fixed[c].cast(casts[c]) if c in casts else fixed[c]).alias(c) for c in EVENT])


def fire(polls: DataFrame, cutoff: Column, *, least_ha: float = 5.0, least_pct: float = 10.0) -> DataFrame:
    """New, upgraded and downgraded warnings, and incidents that grew by least_ha and least_pct since the area before.

    polls: source_id, ts, seq, feed_type, category1, warning_level, size, location, first_seen.
    """
    polls = polls.where(F.coalesce("feed_type", F.lit("")) != "burn-area").withColumn("place", text.place(F.col("location")))
    warning = F.lower("feed_type") == "warning"
    levels = polls.where(warning).withColumns({"level": F.trim("warning_level"), "grade": classify.warning_order(F.col("warning_level"))})
    steps = recorded(levels, "source_id", "grade", "level")
    fresh, up = F.col("prev_value").isNull(), F.col("grade") < F.col("prev_value")
    grave = F.when(F.col("grade") == 1, CRITICAL).otherwise(MAJOR)
    steps = steps.where(~fresh | (F.col("first_seen") >= cutoff)).where(fresh | (F.col("ts") >= cutoff))
    warnings = _entries(
        steps, "fire", "warning_level", kind=F.when(fresh, "new").when(up, "escalation").otherwise("downgrade"), severity=F.when(fresh | up, grave).otherwise(INFO),
        headline=F.when(fresh, F.concat(F.lit("New "), "level", F.lit(" issued"))).otherwise(F.concat(F.lit("Warning "), F.when(up, "upgraded").otherwise("downgraded"), F.lit(" to "), "level", F.lit(" — "), "place")),
        ts=F.when(fresh, F.col("first_seen")).otherwise(F.col("ts")), entity_key=F.col("source_id"), entity_name=F.col("place"), prev_label=F.col("prev_label"), new_label=F.col("level"), since=F.col("since"),
    )
    areas = recorded(polls.where(~F.coalesce(warning, F.lit(False))).withColumn("area", text.hectares(F.col("size"))), "source_id", "area")
    grew = F.col("area") - F.col("prev_value")
    areas = areas.where(F.col("ts") >= cutoff).where(grew >= F.greatest(F.lit(least_ha), F.col("prev_value") * least_pct / 100)).where(grew > 0)
    word = F.coalesce(F.nullif(F.lower(F.trim("category1")), F.lit("")), F.lit("incident"))
    growth = _entries(
        areas, "fire", "area_ha", kind=F.lit("growth"), severity=F.when(F.col("area") >= 1000, CRITICAL).when(F.col("area") >= 100, MAJOR).otherwise(NOTABLE),
        headline=F.concat("place", F.lit(" "), word, F.lit(" increased "), text.number(grew), F.lit(" ha")), ts=F.col("ts"), entity_key=F.col("source_id"), entity_name=F.col("place"), prev_value=F.col("prev_value"), new_value=F.col("area"), since=F.col("since"),
    )
    return warnings.unionByName(growth)


def flood(readings: DataFrame, cutoff: Column, *, rate: float = 0.15, window_minutes: int = 60, repeat_minutes: int = 30) -> DataFrame:
    """Changes of flood class between readings that follow each other, and gauges near or in flood that rise quickly.

    readings: station, ts, seq, height, minor, moderate, major. The rate is that since the first reading within the
    window before the gauge's latest one, or since its first reading of all if the window holds no other; below five
    minutes there is none. A rise is left out where a rise or a crossing came within repeat_minutes before.
    """
    band = lambda c: classify.flood_priority(F.col(c), F.col("minor"), F.col("moderate"), F.col("major"))
    rows = readings.where("height IS NOT NULL AND station IS NOT NULL AND ts IS NOT NULL AND coalesce(minor, moderate, major) IS NOT NULL")
    steps = temporal.with_previous(rows, ["station"], "ts", "seq", ["height", "ts"]).where("prev_height IS NOT NULL").where(F.col("ts") >= cutoff)
    steps = steps.withColumns({"now": band("height"), "before": band("prev_height")}).where("now <> before")
    up = F.col("now") < F.col("before")
    first_word = F.split_part(classify.flood_label(F.col("now")), F.lit(" "), F.lit(1))
    crossings = _entries(
        steps, "flood", "height_m", kind=F.when(up, "threshold").otherwise("receding"), severity=F.when(~up, INFO).when(F.col("now") == 1, CRITICAL).otherwise(MAJOR),
        headline=F.when(up, F.concat(first_word, F.lit(" flood threshold crossed"))).otherwise(F.concat(F.lit("Fallen back to "), F.lower(classify.flood_label(F.col("now"))))),
        ts=F.col("ts"), entity_key=F.col("station"), entity_name=F.col("station").cast("string"), prev_value=F.col("prev_height"), new_value=F.col("height"), prev_label=classify.flood_label(F.col("before")), new_label=classify.flood_label(F.col("now")), since=F.col("prev_ts"),
    )
    last = rows.groupBy("station").agg(F.max_by(F.struct("ts", "height", "minor", "moderate", "major"), F.struct("ts", "seq")).alias("l"))
    near = rows.join(last.select("station", F.col("l.ts").alias("last_ts")), "station")
    inside = F.col("ts") >= F.col("last_ts") - F.make_dt_interval(mins=F.lit(window_minutes))
    order = F.struct("ts", "seq")
    anchors = near.groupBy("station").agg(F.count_if(inside).alias("n"), F.min_by(F.struct("ts", "height"), F.when(inside, order)).alias("recent"), F.min_by(F.struct("ts", "height"), order).alias("first"))
    anchors = anchors.select("station", F.when(F.col("n") >= 2, F.col("recent")).otherwise(F.col("first")).alias("a")).join(last, "station")
    hours = F.timestamp_diff("MICROSECOND", F.col("a.ts"), F.col("l.ts")) / F.lit(3.6e9)
    rising = anchors.select("station", "l.*", F.col("a.ts").alias("since"), F.col("a.height").alias("was"), hours.alias("h")).where(F.col("h") >= 5 / 60).withColumn("now", band("height"))
    rising = rising.where(((F.col("height") - F.col("was")) / F.col("h") >= rate) & ((F.col("now") < 4) | (F.col("height") >= 0.9 * F.col("minor"))) & (F.col("ts") >= cutoff))
    recent = crossings.where("kind = 'threshold'").groupBy("entity_key").agg(F.max("ts").alias("crossed"))
    rising = rising.withColumn("entity_key", F.col("station").cast("string")).join(recent, "entity_key", "left").where(F.col("crossed").isNull() | (F.col("crossed") < F.col("ts") - F.make_dt_interval(mins=F.lit(repeat_minutes))))
    fast = _entries(rising, "flood", "height_m", kind=F.lit("rising"), severity=F.when(F.col("now") < 4, MAJOR).otherwise(NOTABLE), headline=F.concat(F.col("station").cast("string"), F.lit(" rising quickly")), ts=F.col("ts"), entity_key=F.col("station"), entity_name=F.col("station").cast("string"), prev_value=F.col("was"), new_value=F.col("height"), since=F.col("since"))
    return crossings.unionByName(fast)


def power_statewide(series: DataFrame, now: Column, cutoff: Column, *, window_minutes: int = 30, least: float = 500, least_pct: float = 25) -> DataFrame:
    """At most one row: the total against that of the window before, or the oldest of two windows. series: ts, seq, customers_off."""
    minutes = lambda n: F.make_dt_interval(mins=F.lit(n))
    rows = series.where("customers_off IS NOT NULL").where(F.col("ts").between(now - minutes(2 * window_minutes), now)).select("ts", "seq", F.col("customers_off").cast("double").alias("v"))
    row, order = F.struct("ts", "v"), F.struct("ts", "seq")
    last = rows.agg(F.max("ts").alias("last_ts"))
    both = rows.crossJoin(F.broadcast(last)).agg(F.count("*").alias("n"), F.max_by(row, order).alias("l"), F.max_by(row, F.when(F.col("ts") <= F.col("last_ts") - minutes(window_minutes), order)).alias("anchor"), F.min_by(row, order).alias("first"))
    both = both.where("n >= 2").select("l", F.coalesce("anchor", "first").alias("a")).select(F.col("l.ts").alias("ts"), F.col("l.v").alias("v"), F.col("a.ts").alias("since"), F.col("a.v").alias("was"))
    delta = F.col("v") - F.col("was")
    pct = F.try_divide(100 * delta, F.col("was"))
    both = both.where((F.abs(delta) >= least) & (pct.isNull() | (F.abs(pct) >= least_pct)) & (F.col("ts") >= cutoff))
    worse = delta > 0
    return _entries(both, "power", "customers_off", kind=F.when(worse, "deteriorating").otherwise("improving"), severity=F.when(worse & (F.col("v") >= 5000), MAJOR).otherwise(NOTABLE), headline=F.when(worse, "Power situation deteriorating").otherwise("Power situation improving"), ts=F.col("ts"), entity_key=F.lit("statewide"), entity_name=F.lit("Statewide outages"), prev_value=F.col("was"), new_value=F.col("v"), since=F.col("since"))


def power_locations(polls: DataFrame, cutoff: Column, *, least: float = 300) -> DataFrame:
    """New, growing and shrinking outages. polls: location, ts, seq, customers_off, first_seen."""
    steps = recorded(polls.withColumns({"location": text.blank_to_null(F.col("location").cast("string")), "customers_off": F.col("customers_off").cast("double")}), "location", "customers_off")
    c, p = F.col("customers_off"), F.col("prev_value")
    fresh, delta = p.isNull(), c - p
    steps = steps.where((fresh & (F.col("first_seen") >= cutoff) & (c >= least)) | (~fresh & (F.col("ts") >= cutoff) & (F.abs(delta) >= least)))
    grew = F.concat("location", F.lit(" outage "), F.when(delta > 0, "grew").otherwise("shrank"), F.lit(" by "), text.number(F.abs(delta)), F.lit(" customers"))
    return _entries(
        steps, "power", "customers_off", kind=F.when(fresh, "new").when(delta > 0, "growth").otherwise("recovery"), severity=F.when(~fresh & (c >= 5000), MAJOR).otherwise(NOTABLE), headline=F.when(fresh, F.concat(F.lit("New outage at "), "location")).otherwise(grew),
        ts=F.when(fresh, F.col("first_seen")).otherwise(F.col("ts")), entity_key=F.col("location"), entity_name=F.col("location"), prev_value=p, new_value=c, since=F.col("since"),
    )


def storm(cells: DataFrame, cutoff: Column) -> DataFrame:
    """Cells that intensify, and those that leave the strongest class. cells: cell_id, ts, seq, classification."""
    rank = lambda c: classify.lookup(F.lower(c), {"weak": 1, "moderate": 2, "strong": 3})
    rows = temporal.with_previous(cells.where("cell_id IS NOT NULL AND ts IS NOT NULL"), ["cell_id"], "ts", "seq", ["classification", "ts"]).withColumns({"now": rank("classification"), "before": rank("prev_classification")})
    up = F.col("now") > F.col("before")
    rows = rows.where(F.col("ts") >= cutoff).where(up | ((F.col("now") < F.col("before")) & (F.col("before") == 3)))
    return _entries(rows, "storm", "classification", kind=F.when(up, "intensification").otherwise("weakening"), severity=F.when(~up, INFO).when(F.col("now") == 3, CRITICAL).otherwise(MAJOR), headline=F.when(up, "Storm cell intensified").otherwise("Storm cell weakening"), ts=F.col("ts"), entity_key=F.col("cell_id"), entity_name=F.col("cell_id").cast("string"), prev_label=F.initcap("prev_classification"), new_label=F.initcap("classification"), since=F.col("prev_ts"))


def weather(polls: DataFrame, cutoff: Column) -> DataFrame:
    """New, reissued and cancelled warnings. polls: warning_id, ts, seq, issue_time, first_seen, active, group_type, type, title.

    A warning that comes back after it was cancelled is compared with its last issue, and can be cancelled again.
    """
    polls = polls.where("warning_id IS NOT NULL").withColumn("on", F.coalesce(F.col("active").cast("int"), F.lit(0)))
    ended = recorded(polls, "warning_id", "on").where("prev_value = 1 AND on = 0").where(F.col("ts") >= cutoff)
    name = {"entity_key": F.col("warning_id"), "entity_name": F.coalesce("title", F.lit("Weather warning"))}
    cleared = _entries(ended, "weather", "active", kind=F.lit("cleared"), severity=F.lit(INFO), headline=F.lit("Weather warning no longer current"), ts=F.col("ts"), prev_label=F.lit("Active"), new_label=F.lit("Cancelled"), since=F.col("since"), **name)
    issues = recorded(polls.where("on = 1"), "warning_id", "issue_time")
    fresh, clock = F.col("prev_value").isNull(), lambda c: F.date_format(c, "HH:mm")
    issues = issues.where((fresh & (F.col("first_seen") >= cutoff)) | (~fresh & (F.col("issue_time") >= cutoff)))
    grave = F.lower("group_type").isin("major", "severe")
    issued = _entries(issues.withColumn("was", F.col("prev_value")), "weather", "issue_time", kind=F.when(fresh, "new").otherwise("reissued"), severity=F.when(fresh & grave, MAJOR).otherwise(NOTABLE), headline=F.when(fresh, "New weather warning issued").otherwise("Weather warning reissued"), ts=F.col("issue_time"), prev_label=clock(F.col("was")), new_label=F.when(fresh, text.pretty(F.col("type"))).otherwise(clock(F.col("issue_time"))), since=F.col("was"), **name)
    return issued.unionByName(cleared)


def roads(polls: DataFrame, cutoff: Column) -> DataFrame:
    """Roads that close and reopen. polls: source_id, ts, seq, is_closure, resolved, road_name, location, first_seen."""
    shut = (F.coalesce(F.col("is_closure").cast("int"), F.lit(0)) == 1) & (F.coalesce(F.col("resolved").cast("int"), F.lit(0)) == 0)
    steps = recorded(polls.withColumns({"shut": shut.cast("int"), "road": F.coalesce("road_name", "location", F.lit("Road"))}), "source_id", "shut")
    fresh, closed = F.col("prev_value").isNull(), F.col("shut") == 1
    steps = steps.where((fresh & closed & (F.col("first_seen") >= cutoff)) | (~fresh & (F.col("ts") >= cutoff)))
    word = lambda c: F.when(c == 1, "Closed").otherwise("Open")
    return _entries(steps, "roads", "closed", kind=F.when(closed, "new").otherwise("cleared"), severity=F.when(closed, NOTABLE).otherwise(INFO), headline=F.concat("road", F.when(closed, " closed").otherwise(" reopened")), ts=F.when(fresh, F.col("first_seen")).otherwise(F.col("ts")), entity_key=F.col("source_id"), entity_name=F.col("road"), prev_label=F.when(~fresh, word(F.col("prev_value"))), new_label=F.when(~fresh, word(F.col("shut"))), since=F.col("since"))


def rainfall(readings: DataFrame, now: Column, cutoff: Column, *, window_minutes: int = 60, burst: float = 10.0) -> DataFrame:
    """Stations whose counter grew by `burst` within the window, restarts allowed for. readings: wmo, ts, seq, name, rain."""
    rows = readings.where(F.col("ts").between(now - F.make_dt_interval(mins=F.lit(window_minutes)), now))
    total = temporal.reset_total(rows, ["wmo"], "ts", "seq", "rain").where((F.col("readings") >= 2) & (F.col("total") >= burst))
    last = rows.groupBy("wmo").agg(F.max_by("name", F.struct("ts", "seq")).alias("name"), F.max("ts").alias("ts"), F.min("ts").alias("since"))
    rows = total.join(last, "wmo").where(F.col("ts") >= cutoff)
    name = F.coalesce("name", F.col("wmo").cast("string"))
    return _entries(rows, "rainfall", "rain_mm", kind=F.lit("burst"), severity=F.when(F.col("total") >= 2 * burst, MAJOR).otherwise(NOTABLE), headline=F.concat(F.lit("Heavy rainfall at "), name), ts=F.col("ts"), entity_key=F.col("wmo"), entity_name=name, new_value=F.col("total"), since=F.col("since"))


#: Kinds that come again and again, and what holds each back if it was shown shortly before.
REPEATED = {("flood", "rising"): ["rising", "threshold"], ("power", "deteriorating"): ["deteriorating"], ("power", "improving"): ["improving"], ("rainfall", "burst"): ["burst"]}


def additions(stored: DataFrame, *found: DataFrame, repeat_minutes: int = 30) -> DataFrame:
    """The entries that a pass of detectors adds to those stored: no entry twice, and no repeat of one's kind.

    Kinds of REPEATED are left out within repeat_minutes after an entry, stored or added, of their hazard, entity and of a
    kind that holds them back; what was left out holds nothing back.
    """
    rows = reduce(DataFrame.unionByName, found).withColumn("_seq", F.xxhash64(*EVENT_KEY, "headline"))
    new = written(changes.new_rows(stored, rows, EVENT_KEY, "_seq"), "entries")
    kinds = F.struct("hazard", "kind")
    repeated = lambda pairs: kinds.isin([F.struct(F.lit(h).alias("hazard"), F.lit(k).alias("kind")) for h, k in pairs])
    held = F.coalesce(repeated(REPEATED), F.lit(False))
    # an entry that holds back entries of another kind counts as a stored one of that kind
    others = [(h, by, kind) for (h, kind), bys in REPEATED.items() for by in bys if by != kind]
    before = stored.select("hazard", "entity_key", "kind", "ts")
    for h, by, kind in others:
        both = stored.select(EVENT).unionByName(new.select(EVENT))
        before = before.unionByName(both.where((F.col("hazard") == h) & (F.col("kind") == by)).select("hazard", "entity_key", F.lit(kind).alias("kind"), "ts"))
    shown = folds.spaced(new.where(held), ["hazard", "entity_key", "kind"], "ts", "_seq", repeat_minutes, before)
    return new.where(~held).unionByName(shown).select(EVENT)
