"""The whole briefing as text: seven sections, each of rows that are few by then; one without rows says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify, text, times
from tidewatch.operators.views import SEVERITIES

#: What a section without rows says.
NO_CHANGES, NO_WARNINGS, NO_CONSEQUENCES, NO_POINTS = "No significant changes detected in this period.", "None active.", "No significant cross-layer consequences currently identified.", "Nothing currently approaching a threshold."
NOT_CHECKED = "Raw BoM automatic weather station observations — not quality-controlled, not an official warning product."


def _section(part: int, name: str, rows: DataFrame, order: list[Column], lines: Column, nothing: str | None = None, after: Column | None = None) -> DataFrame:
    """(part, k, line): a heading, the lines of all rows in order, or the words for none, and what comes after."""
    keyed = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], lines.alias("lines"))
    all_ = rows.agg(F.flatten(F.transform(F.sort_array(F.collect_list(keyed)), lambda x: x["lines"])).alias("all"))
    none = F.array(F.lit(f"  {nothing}")) if nothing else F.array().cast("array<string>")
    body = F.when(F.size("all") > 0, F.col("all")).otherwise(none)
    return all_.select(F.lit(part).alias("part"), F.posexplode(F.concat(F.array(F.lit(name)), body, F.array_compact(F.array(F.lit(None).cast("string") if after is None else after)))).alias("k", "line"))


def _under(head: Column, lines: Column) -> Column:
    """A line and those that belong to it, further in."""
    return F.concat(F.array(F.concat(F.lit("  "), head)), F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.concat(F.lit("      "), x)))


def _figure() -> Column:
    """A figure with its detail, if it has one."""
    value = F.concat("value", F.coalesce(F.concat(F.lit(" — "), text.blank_to_null(F.col("detail"))), F.lit("")))
    return F.array(F.format_string("  %-28s %s", "label", value))


def report(generated: Column, minutes: int, figures: DataFrame, changes: DataFrame, warnings: DataFrame, omitted: DataFrame, consequences: DataFrame, points: DataFrame, weather: DataFrame, sources: DataFrame) -> DataFrame:
    """(part, k, line): the briefing, a row for each line, in order of part and k.

    figures, weather: position, label, value, detail; changes: severity, ts, headline, lines; warnings and omitted: of
    `figures.briefing_warnings`; consequences: position, title, lines; points: position, kind, title, lines; sources: source,
    age in minutes, state. Changes come by severity and then the newest, the rest by position.
    """
    label = times.window_label(minutes)
    head = F.array(F.lit("OPERATIONAL BRIEFING"), F.concat(F.lit("Generated "), F.date_format(generated, "dd MMM yyyy HH:mm")), F.lit(f"Changes since: last {label}"))
    title = figures.sparkSession.range(1).select(F.lit(0).alias("part"), F.posexplode(head).alias("k", "line"))
    change = F.concat(F.coalesce(F.date_format("ts", "HH:mm"), F.lit("--:--")), F.lit("  ["), classify.lookup(F.col("severity"), SEVERITIES), F.lit("] "), "headline")
    issued = F.coalesce(F.date_format("issued", "dd MMM HH:mm"), F.lit("—"))
    warning = F.array(F.concat(F.lit("  "), F.coalesce(F.concat(F.lit("["), "level", F.lit("] ")), F.lit("")), "kind", F.lit(" — "), "title", F.lit(" (issued "), issued, F.lit(")")))
    source = F.array(F.concat(F.format_string("  %-14s ", "source"), times.describe_age(F.col("age")), F.when(F.col("state") == "ok", "").otherwise("   <-- CHECK")))
    newest = F.coalesce(-F.unix_micros(F.col("ts").cast("timestamp")), F.lit((1 << 63) - 1))
    at, own = [F.col("position")], F.col("source") == "VicEmergency"
    left = omitted.where("omitted > 0").select(F.lit(3).alias("part"), F.lit(1_000_000).alias("k"), F.concat(F.lit("  ... and "), text.plural(F.col("omitted"), "further Advice warning"), F.lit(" not listed.")).alias("line"))
    parts = [
        title,
        _section(1, "CURRENT SITUATION", figures, at, _figure()),
        _section(2, f"SIGNIFICANT CHANGES (last {label})", changes, [-F.col("severity"), newest, F.col("headline")], _under(change, F.col("lines")), NO_CHANGES),
        _section(3, "ACTIVE WARNINGS — VICEMERGENCY", warnings.where(own), at, warning, NO_WARNINGS),
        left,
        _section(4, "ACTIVE WARNINGS — BOM", warnings.where(~own), at, warning, NO_WARNINGS),
        _section(5, "EMERGING CONSEQUENCES", consequences, at, _under(F.col("title"), F.col("lines")), NO_CONSEQUENCES),
        _section(6, "WATCH POINTS", points, at, _under(F.concat(F.lit("["), "kind", F.lit("] "), "title"), F.col("lines")), NO_POINTS),
        _section(7, "WEATHER OBSERVATIONS", weather, at, _figure(), after=F.lit(f"  {NOT_CHECKED}")),
        _section(8, "DATA FRESHNESS", sources, [F.col("source")], source),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("part", "k")
