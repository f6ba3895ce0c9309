"""Figures of the situation: what is counted, what is highest, and the warnings of both authorities for a briefing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import classify, text
from tidewatch.operators.temporal import with_previous

#: Warning levels that a briefing lists, in order, and how many of the last one.
LEVELS = ["Emergency Warning", "Watch and Act", "Advice"]
ADVICE_LIMIT = 5
FIGURE = ["position", "label", "value", "alert", "detail"]


def warning_counts(warnings: DataFrame) -> DataFrame:
    """One row: total, flood, severe and major of active warnings (type, group_type, active); flood and severe by their type's name."""
    rows = warnings.where("active = 1")
    kind = F.coalesce("type", F.lit(""))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.contains(kind, F.lit("flood"))).alias("flood"), F.count_if(F.contains(kind, F.lit("severe"))).alias("severe"), F.count_if(F.lower("group_type").isin("major", "severe")).alias("major"))


def storm_counts(cells: DataFrame) -> DataFrame:
    """One row: total, strong, moderate and, as a whole number, the highest intensity of cells (classification, intensity_score); 0 without any."""
    c = F.col("classification")
    return cells.agg(F.count("*").alias("total"), F.count_if(c == "strong").alias("strong"), F.count_if(c == "moderate").alias("moderate"), F.coalesce(F.max("intensity_score").cast("int"), F.lit(0)).alias("max_intensity"))


def cell_history(cells: DataFrame, start: Column, top: int = 12) -> DataFrame:
    """Rows since a time of the `top` cells with the highest intensity since then. cells: cell_id, ts, intensity_score and more."""
    rows = cells.where(F.col("ts") >= start)
    strongest = rows.groupBy("cell_id").agg(F.max("intensity_score").alias("m")).where("m IS NOT NULL").orderBy(F.desc("m"), "cell_id").limit(top)
    return rows.join(strongest.select("cell_id"), "cell_id", "left_semi")


def fire_totals(series: DataFrame) -> DataFrame:
    """series with warnings_total, and incidents_total: the active ones that aren't warnings, never below 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    warnings = zero("emergency_warnings") + zero("watch_act") + zero("advice")
    return series.withColumns({"warnings_total": warnings, "incidents_total": F.greatest(F.lit(0), zero("total_active") - warnings)})


def peaks(series: DataFrame, value: str, spans: dict[str, str]) -> DataFrame:
    """(label, peak, peak_ts): the highest value of each span before the series' last time, the first of equals. series: ts and values."""
    rows = series.where(F.col("ts").isNotNull())
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("_last"))))
    labels = F.array_compact(F.array(*[F.when(F.col("ts") >= F.col("_last") - F.expr(f"INTERVAL {span}"), label) for label, span in spans.items()]))
    rows = rows.where(F.col(value).isNotNull()).withColumn("label", F.explode(labels))
    first = F.struct(F.col(value).alias("v"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    return rows.groupBy("label").agg(F.max(value).alias("peak"), F.max_by("ts", first).alias("peak_ts"))


def metric_records(polls: DataFrame, keys: list[str], ts: str, seq: str, value: str, label: str, tolerance: float = 1e-9) -> DataFrame:
    """polls that differ from the one before in value, by the tolerance or more, or in label; the first of a key counts. Nulls are equal to nulls."""
    rows = with_previous(polls, keys, ts, seq, [value, label, seq])
    v, p = F.col(value), F.col(f"prev_{value}")
    same = F.coalesce(F.abs(v - p) < tolerance, v.isNull() & p.isNull()) & F.col(label).eqNullSafe(F.col(f"prev_{label}"))
    return rows.where(F.col(f"prev_{seq}").isNull() | ~same).drop(f"prev_{seq}")


def briefing_warnings(incidents: DataFrame, weather: DataFrame, advice_limit: int = ADVICE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """((position, source, level, kind, title, issued), (omitted)): active warnings of both authorities, and how many of the least grave were left out.

    incidents: seq, feed_type, warning_level, event, category1, category2, location, headline, created, updated, resolved;
    weather: seq, type, title, group_type, issue_time, active. The first are listed by level and the latest update,
    advice a few only, then the others by group and issue time. These are what is active at one time.
    """
    level = F.trim("warning_level")
    grade = F.coalesce(*[F.when(level == x, k) for k, x in enumerate(LEVELS)])
    rows = incidents.where("feed_type = 'warning' AND resolved = 0").withColumns({"level": level, "grade": grade}).where("grade IS NOT NULL")
    order = [F.desc_nulls_last("updated"), "seq"]
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("grade").orderBy(*order)))
    last = len(LEVELS) - 1
    kept, left = ranked.where((F.col("grade") < last) | (F.col("k") <= advice_limit)), ranked.where((F.col("grade") == last) & (F.col("k") > advice_limit))
    or_else = lambda *cs: F.coalesce(*[text.blank_to_null(F.col(c)) for c in cs])
    a = kept.select(F.lit(0).alias("authority"), "grade", "k", F.lit("VicEmergency").alias("source"), "level", F.coalesce(or_else("event", "category2", "category1"), F.lit("Incident")).alias("kind"), F.coalesce(or_else("location", "headline"), F.lit("Warning")).alias("title"), F.col("created").alias("issued"))
    group = classify.group_priority(F.col("group_type"))
    b = weather.where("active = 1").withColumn("grade", group).withColumn("k", F.row_number().over(Window.partitionBy("grade").orderBy(F.desc_nulls_last("issue_time"), "seq")))
    b = b.select(F.lit(1).alias("authority"), "grade", "k", F.lit("BoM").alias("source"), F.lit(None).cast("string").alias("level"), F.coalesce(text.blank_to_null(text.pretty(F.col("type"))), F.lit("Warning")).alias("kind"), F.coalesce("title", F.lit("")).alias("title"), F.col("issue_time").alias("issued"))
    listed = a.unionByName(b).agg(F.sort_array(F.collect_list(F.struct("authority", "grade", "k", "source", "level", "kind", "title", "issued"))).alias("all"))
    out = listed.select(F.posexplode("all").alias("position", "x")).select("position", "x.source", "x.level", "x.kind", "x.title", "x.issued")
    return out, left.agg(F.count("*").alias("omitted"))


def _figure(position: int, label: str, rows: DataFrame, value: Column, alert: Column | None = None, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(position).alias("position"), F.lit(label).alias("label"), value.cast("string").alias("value"), F.coalesce(F.lit(False) if alert is None else alert, F.lit(False)).alias("alert"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def situation(power: DataFrame, gauges: DataFrame, fires: DataFrame, weather: DataFrame, roads: DataFrame, cells: DataFrame, rain: DataFrame, *, high: int = 20_000) -> DataFrame:
    """FIGURE rows, twelve of them: customers off, gauges by class, fires and warnings by level, and so on; "—" where nothing is known.

    power: ts, seq, customers_off; gauges: priority; fires: category1, feed_type, warning_level, resolved; weather: active,
    type, group_type; roads: is_closure, resolved; cells: active ones; rain: station, value. Each is read once.
    """
    off = power.agg(F.max_by("customers_off", F.struct("ts", "seq")).alias("off"))
    p = F.col("priority")
    flood = gauges.agg(F.count_if(p <= 3).alias("minor"), F.count_if(p <= 2).alias("moderate"), F.count_if(p == 1).alias("major"))
    warning = F.coalesce(F.col("feed_type") == "warning", F.lit(False))
    level = F.lower(F.trim("warning_level"))
    fire = fires.where("resolved = 0").agg(F.count_if(~warning & (F.lower("category1") == "fire")).alias("active"), F.count_if(warning & level.isin("emergency warning", "evacuate", "evacuation")).alias("emergency"), F.count_if(warning & (level == "watch and act")).alias("watch"))
    road = roads.where("resolved = 0").agg(F.count("*").alias("total"), F.count_if(F.col("is_closure") == 1).alias("closures"))
    storm = storm_counts(cells)
    wet = rain.where("value IS NOT NULL").agg(F.max_by(F.struct("station", "value"), F.struct(F.col("value"), F.col("station"))).alias("w"))
    some = lambda c: F.col(c) > 0
    return reduce(DataFrame.unionByName, [
        _figure(0, "Customers Without Power", off, text.count_text(F.col("off")), F.col("off") > high),
        *[_figure(k, f"Gauges ≥ {c.title()}", flood, F.col(c), some(c)) for k, c in enumerate(("minor", "moderate", "major"), 1)],
        _figure(4, "Active Fires", fire, F.col("active"), some("active")), _figure(5, "Emergency Warnings", fire, F.col("emergency"), some("emergency")), _figure(6, "Watch & Act", fire, F.col("watch"), some("watch")),
        _figure(7, "Active BoM Warnings", warning_counts(weather), F.col("total"), some("total")),
        _figure(8, "Road Disruptions", road, F.col("total")), _figure(9, "Full Closures", road, F.col("closures"), some("closures")),
        _figure(10, "Storm Cells (mod/strong)", storm, F.col("strong") + F.col("moderate"), some("strong")),
        _figure(11, "Wettest Station (since 9am)", wet, text.measured(F.col("w.value"), 1, "mm"), None, F.col("w.station")),
    ]).orderBy("position")


def weather_block(stations: DataFrame) -> DataFrame:
    """(position, label, value, detail): strongest gust, lowest humidity, wettest, highest gust today with its time; "—" without readings.

    stations: station, gust, humidity, rain, daily_gust, daily_gust_time: the latest of each. Of equals the first by name counts.
    """
    def best(c: str, low: bool = False) -> Column:
        v = F.col(c).cast("double")
        order = F.struct((v if low else -v).alias("v"), "station")
        return F.min_by(F.struct("station", v.alias("value"), "daily_gust_time"), F.when(v.isNotNull(), order)).alias(c)

    rows = stations.agg(best("gust"), best("humidity", low=True), best("rain"), best("daily_gust"))
    parts = [("Strongest current gust", "gust", 0, "km/h"), ("Lowest relative humidity", "humidity", 0, "%"), ("Wettest since 9am", "rain", 1, "mm"), ("Highest gust today", "daily_gust", 0, "km/h")]
    made = []
    for k, (label, c, places, unit) in enumerate(parts):
        when = F.coalesce(F.concat(F.lit(" ("), text.blank_to_null(F.col(f"{c}.daily_gust_time")), F.lit(")")), F.lit("")) if c == "daily_gust" else F.lit("")
        made.append(F.struct(F.lit(k).alias("position"), F.lit(label).alias("label"), text.measured(F.col(f"{c}.value"), places, unit).alias("value"), F.concat(F.col(f"{c}.station").cast("string"), when).alias("detail")))
    return rows.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def first_seen_order(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key by `order`; keys stay in the order in which they came first."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_r"))
    return first.select(*[F.col(c) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])
