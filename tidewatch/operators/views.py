"""What people read: figures as they stood at a time, the ticker, watch points, the timeline, the briefing and exports.

Every view is a DataFrame of a bounded number of rows out of aggregates over whole tables; the time asked about is an
argument. An unknown figure is "—", which isn't 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewatch.functions import classify, text, times
from tidewatch.operators.temporal import latest

KPI = ["position", "label", "value"]
#: Fixed value: what makes a warning an emergency, whatever its type.
EMERGENCY_TEXT = "standard emergency warning signal"
SEVERITIES = {3: "CRITICAL", 2: "MAJOR", 1: "NOTABLE", 0: "INFO"}


def _back(when: Column, minutes: float) -> Column:
    return when - F.make_dt_interval(secs=F.lit(float(minutes) * 60))


def figure(series: DataFrame, column: str, when: Column, label: str, position: int, *, max_age_h: float = 6) -> DataFrame:
    """KPI: a series' last figure at or before a time, unknown if it is too old or was null. series: ts, seq and the column."""
    rows = series.where(F.col("ts").between(_back(when, max_age_h * 60), when))
    last = rows.agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct("ts", "seq")).alias("r"))
    return last.select(F.lit(position).alias("position"), F.lit(label).alias("label"), text.count_text(F.col("r.v")).alias("value"))


def historical_kpis(figures: list[tuple[str, DataFrame, str]], readings: DataFrame, when: Column, *, stale_h: float = 24) -> DataFrame:
    """KPI rows in the order given, then the gauges at or above minor. figures: label, series, column; readings: station, ts, seq, height, minor, moderate, major."""
    rows = [figure(series, column, when, label, k) for k, (label, series, column) in enumerate(figures)]
    fresh = latest(readings.where(F.col("ts").between(_back(when, stale_h * 60), when)), ["station"], ["ts", "seq"])
    minor = F.count_if(classify.flood_priority(F.col("height"), F.col("minor"), F.col("moderate"), F.col("major")) <= 3)
    gauges = fresh.agg(minor.cast("string").alias("value")).select(F.lit(len(figures)).alias("position"), F.lit("Gauges ≥ Minor").alias("label"), "value")
    return reduce(DataFrame.unionByName, [*rows, gauges]).orderBy("position")


def significant(entries: DataFrame, start: Column, end: Column, *, least: int = classify.NOTABLE, limit: int = 40) -> DataFrame:
    """Entries of a window, at most `limit` of the newest, the gravest first and then the newest."""
    rows = entries.where(F.col("ts").between(start, end) & (F.col("severity") >= least)).orderBy(F.desc("ts"), "entity_key", "kind").limit(limit)
    return rows.orderBy(F.desc("severity"), F.desc("ts"), "entity_key", "kind")


def timeline(entries: DataFrame, start: Column, end: Column, *, least: int = classify.NOTABLE, limit: int = 200) -> DataFrame:
    """Entries of a span, oldest first; of more than `limit` the newest."""
    return significant(entries, start, end, least=least, limit=limit).orderBy("ts", "entity_key", "kind")


def coverage(journal: DataFrame, event_start: Column) -> DataFrame:
    """(source, available_from, journal_from, full_fidelity): whether an event can be replayed from recorded states alone."""
    starts = journal.groupBy("source").agg(F.min("effective_ts").alias("available_from"))
    all_ = starts.agg(F.max("available_from").alias("journal_from"))
    return starts.crossJoin(F.broadcast(all_)).withColumn("full_fidelity", event_start >= F.col("journal_from"))


def crossings(readings: DataFrame, now: Column) -> DataFrame:
    """(station, priority, crossed_at) of gauges in flood by their latest reading: the first reading after the last one below minor.

    readings: station, ts, seq, height, minor, moderate, major. Gauges that were never below minor have no crossing.
    """
    rows = readings.where((F.col("ts") <= now) & F.col("height").isNotNull() & F.col("minor").isNotNull())
    state = rows.groupBy("station").agg(F.max_by(F.struct("height", "minor", "moderate", "major"), F.struct("ts", "seq")).alias("l"), F.max(F.when(F.col("height") < F.col("minor"), F.col("ts"))).alias("below"))
    priority = classify.flood_priority(F.col("l.height"), F.col("l.minor"), F.col("l.moderate"), F.col("l.major"))
    state = state.select("station", "below", priority.alias("priority")).where("priority < 4 AND below IS NOT NULL")
    return rows.join(state, "station").where("ts > below").groupBy("station", "priority").agg(F.min("ts").alias("crossed_at"))


def ticker(weather: DataFrame, warnings: DataFrame, readings: DataFrame, now: Column, *, minutes: float = 5) -> DataFrame:
    """(ts, emergency, item), newest first: warnings and crossings of the last minutes, and emergencies however old.

    weather: title, message, first_seen, active; warnings: warning_level, location, event, first_seen, resolved.
    """
    signal = F.contains(F.lower(F.concat_ws(" ", "title", "message")), F.lit(EMERGENCY_TEXT))
    a = weather.where("active = 1").select(F.col("first_seen").alias("ts"), signal.alias("emergency"), F.concat(F.when(signal, "SEWS — ").otherwise(""), F.coalesce("title", F.lit("Weather warning"))).alias("item"))
    level = F.coalesce("warning_level", F.lit("Warning"))
    grave = F.lower(F.trim(level)).isin("emergency warning", "evacuate", "evacuation")
    event = F.coalesce(F.concat(F.lit(" ("), text.blank_to_null(F.col("event")), F.lit(")")), F.lit(""))
    b = warnings.where("resolved = 0").select(F.col("first_seen").alias("ts"), grave.alias("emergency"), F.concat(level, F.lit(" — "), F.coalesce("location", F.lit("whole state")), event).alias("item"))
    c = crossings(readings, now).select(F.col("crossed_at").alias("ts"), F.lit(False).alias("emergency"), F.concat(F.col("station").cast("string"), F.lit(" — "), classify.flood_label(F.col("priority"))).alias("item"))
    rows = a.unionByName(b).unionByName(c).where(F.col("emergency") | (F.col("ts") >= _back(now, minutes)))
    return rows.orderBy(F.desc_nulls_last("ts"), "item")


def watch_points(analysed: DataFrame, cells: DataFrame, gusts: DataFrame, *, near_m: float = 0.5, gust_kmh: float = 70, limit: int = 8) -> DataFrame:
    """(position, kind, title, lines): rising gauges near their next level, the strongest storm cells, strong gusts.

    analysed: station, target, current, rate, eta_point (hours or null); cells: cell_id, classification, intensity_score,
    speed_kmh, bearing_deg, area_km2; gusts: name, gust. An arrival time makes an entry a PROJECTION.
    """
    analysed = analysed.withColumns({c: F.col(c).cast("double") for c in ("target", "current", "rate", "eta_point")})
    cells = cells.withColumns({c: F.col(c).cast("double") for c in ("speed_kmh", "bearing_deg", "area_km2")})
    gusts = gusts.withColumn("gust", F.col("gust").cast("double"))
    d = F.col("target") - F.col("current")
    near = analysed.where((d > 0) & (d <= near_m) & (F.col("rate") > 0)).orderBy(d, "station").limit(limit)
    due = F.col("eta_point").isNotNull()
    away = F.concat(F.format_string("%.2f m below %.2f m · rising %+.2f m/hr", d, F.col("target"), F.col("rate")))
    a = near.select(F.lit(1).alias("part"), F.row_number().over(Window.orderBy(d, "station")).alias("k"), F.when(due, "PROJECTION").otherwise("OBSERVED").alias("kind"), F.col("station").cast("string").alias("title"), F.array_compact(F.array(away, F.when(due, F.format_string("Projected to reach it in about %.1f hr; not an official forecast", "eta_point")))).alias("lines"))
    strong = cells.where("classification IN ('strong', 'moderate')").orderBy(F.desc("intensity_score"), "cell_id").limit(4)
    moving = F.concat_ws(" · ", F.initcap("classification"), F.concat(classify.cardinal(F.col("bearing_deg"), classify.POINTS_16), F.format_string(" at %.0f km/h", "speed_kmh")), F.format_string("~%.0f km²", "area_km2"))
    b = strong.select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy(F.desc("intensity_score"), "cell_id")).alias("k"), F.lit("OBSERVED").alias("kind"), F.concat(F.lit("Storm cell "), "cell_id").alias("title"), F.array(moving).alias("lines"))
    top = gusts.where(F.col("gust") >= gust_kmh).orderBy(F.desc("gust"), "name").limit(3)
    line = F.concat("name", F.format_string(" — %.0f km/h", "gust"))
    c = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("gust")).alias("g"), "name", line.alias("line")))).alias("all")).where(F.size("all") > 0)
    c = c.select(F.lit(3).alias("part"), F.lit(1).alias("k"), F.lit("OBSERVED").alias("kind"), F.lit("Strong wind gusts observed").alias("title"), F.transform("all", lambda x: x["line"]).alias("lines"))
    rows = a.unionByName(b).unionByName(c).orderBy("part", "k").limit(limit)
    return rows.select(F.row_number().over(Window.orderBy("part", "k")).alias("position"), "kind", "title", "lines")


def _section(name: str, part: int, rows: DataFrame, line: Column, order: list, nothing: str) -> DataFrame:
    """Lines of a section after its heading, or the words for none of them; rows are few and read once."""
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("k"), line.alias("line"))
    lines = numbered.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]).alias("lines"))
    some = F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.array(F.lit(f"  {nothing}")))
    return lines.select(F.lit(part).alias("part"), F.posexplode(F.concat(F.array(F.lit(name)), some)).alias("k", "line"))


def briefing(generated: Column, minutes: int, kpis: DataFrame, changes: DataFrame, warnings: DataFrame, points: DataFrame, sources: DataFrame) -> DataFrame:
    """(part, k, line): the briefing as text, a row for each line, in order of part and k.

    kpis: position, label, value; changes: EVENT rows, a few; warnings: level, title, issued; points: watch_points;
    sources: source, age in minutes, state. These are small: the views above bound them.
    """
    label = times.window_label(minutes)
    title = kpis.sparkSession.range(1).select(F.lit(0).alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("OPERATIONAL BRIEFING").alias("line")), F.struct(F.lit(1).alias("k"), F.concat(F.lit("Generated "), F.date_format(generated, "dd MMM yyyy HH:mm")).alias("line")), F.struct(F.lit(2).alias("k"), F.lit(f"Changes since: last {label}").alias("line")))).alias("x")).select("part", "x.*")
    change = F.concat(F.lit("  "), F.date_format("ts", "HH:mm"), F.lit("  ["), classify.lookup(F.col("severity"), SEVERITIES), F.lit("] "), "headline")
    warning = F.concat(F.lit("  "), F.coalesce(F.concat(F.lit("["), "level", F.lit("] ")), F.lit("")), "title", F.lit(" (issued "), F.coalesce(F.date_format("issued", "dd MMM HH:mm"), F.lit("—")), F.lit(")"))
    point = F.concat(F.lit("  ["), "kind", F.lit("] "), "title", F.lit(": "), F.array_join("lines", "; "))
    source = F.concat(F.format_string("  %-14s ", "source"), times.describe_age(F.col("age")), F.when(F.col("state") == "ok", "").otherwise("   <-- CHECK"))
    parts = [
        _section("CURRENT SITUATION", 1, kpis, F.format_string("  %-28s %s", "label", "value"), ["position"], "No figures."),
        _section(f"SIGNIFICANT CHANGES (last {label})", 2, changes, change, [F.desc("severity"), F.desc("ts"), "headline"], "No significant changes detected in this period."),
        _section("ACTIVE WARNINGS", 3, warnings, warning, ["level", F.desc("issued"), "title"], "None active."),
        _section("WATCH POINTS", 4, points, point, ["position"], "Nothing currently approaching a threshold."),
        _section("DATA FRESHNESS", 5, sources, source, ["source"], "No sources."),
    ]
    return reduce(DataFrame.unionByName, [title, *parts]).orderBy("part", "k")


def feature_collection(rows: DataFrame, feature: str = "impact_geojson") -> DataFrame:
    """One row: a GeoJSON FeatureCollection of a bounded table's features; what isn't JSON is left out."""
    good = rows.where(F.try_parse_json(feature).isNotNull())
    made = good.agg(F.array_join(F.sort_array(F.collect_list(feature)), ",").alias("f"))
    return made.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("geojson"))


def export_bundle(tables: dict[str, tuple[DataFrame, str]], path: str, start: Column, end: Column, *, format: str = "parquet") -> list[str]:
    """Write each table's rows of a span (by its column of time) below path, and give the folders written, sorted.

    A table without rows in the span gets a folder, too, so an export always has the same parts.
    """
    made = []
    for name, (rows, ts) in sorted(tables.items()):
        out = f"{path.rstrip('/')}/{name}"
        rows.where(F.col(ts).between(start, end)).write.mode("errorifexists").format(format).options(**({"header": True} if format == "csv" else {})).save(out)
        made.append(out)
    return made


def summary(spark: SparkSession, tables: dict[str, tuple[DataFrame, str]], start: Column, end: Column) -> DataFrame:
    """(name, rows, first_ts, last_ts) of what an export of a span holds."""
    counted = [rows.where(F.col(ts).between(start, end)).agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")) for name, (rows, ts) in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counted) if counted else spark.createDataFrame([], "name string, rows long, first_ts timestamp_ntz, last_ts timestamp_ntz")
