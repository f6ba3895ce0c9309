"""Times: naive local timestamps (timestamp_ntz) throughout; the current time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL = "Australia/Melbourne"
#: Labels of the briefing windows, by minutes.
WINDOWS = {30: "30 minutes", 60: "1 hour", 180: "3 hours", 360: "6 hours", 720: "12 hours"}


def at(text: str) -> Column:
    """A literal timestamp."""
    return F.lit(text).cast("timestamp_ntz")


def parse(c: Column, *formats: str) -> Column:
    """The first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def iso_to_local(c: Column) -> Column:
    """ISO 8601 with Z or an offset as naive local time in whole seconds; null if it isn't that."""
    text = F.trim(c)
    body = F.regexp_extract(text, "^(\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(?::\\d\\d)?)", 1)
    zone = F.regexp_extract(text, "(Z|[+-]\\d\\d:?\\d\\d)$", 1)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    digits = F.replace(zone, F.lit(":"), F.lit(""))
    minutes = F.when(zone == "Z", 0).when(zone != "", sign * (F.substr(digits, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(digits, F.lit(4), F.lit(2)).try_cast("int")))
    naive = parse(F.replace(F.nullif(body, F.lit("")), F.lit("T"), F.lit(" ")), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
    utc = naive - F.make_dt_interval(mins=minutes)
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL), utc)


def utc_to_local(c: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL), c)


def weekday_time(c: Column, now: Column) -> Column:
    """"02.31PM Sun": the last such weekday and time that isn't over two minutes after now; null if it isn't that."""
    pattern = "^\\s*(\\d{1,2})[.:](\\d\\d)\\s*([AaPp][Mm])\\s+([A-Za-z]{3})"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    names = F.array(*[F.lit(x) for x in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")])
    day = F.nullif(F.array_position(names, F.lower(part(4))), F.lit(0).cast("bigint")) - 1
    hour = F.pmod(part(1).try_cast("int"), F.lit(12)) + F.when(F.upper(part(3)) == "PM", 12).otherwise(0)
    back = F.pmod(F.weekday(now) - day, F.lit(7)).cast("int")
    guess = F.date_trunc("day", now).cast("timestamp_ntz") - F.make_dt_interval(days=back) + F.make_dt_interval(hours=hour.cast("int"), mins=part(2).try_cast("int"))
    return F.when(guess > now + F.expr("INTERVAL 2 MINUTES"), guess - F.expr("INTERVAL 7 DAYS")).otherwise(guess)


def day_time(c: Column, now: Column) -> Column:
    """"01/09:30am": that day of this month, or of the last one if it would be over a day after now; null if no such day."""
    pattern = "^\\s*(\\d{1,2})/(\\d{1,2}):(\\d\\d)([ap]m)"
    part = lambda k: F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    hour = F.pmod(part(2).try_cast("int"), F.lit(12)) + F.when(part(4) == "pm", 12).otherwise(0)

    def on(month: Column) -> Column:
        text = F.format_string("%s-%02d %02d:%02d", F.date_format(month, "yyyy-MM"), part(1).try_cast("int"), hour, part(3).try_cast("int"))
        return parse(text, "yyyy-MM-dd HH:mm")

    this = on(now)
    return F.when(part(1).isNotNull(), F.when(this > now + F.expr("INTERVAL 1 DAY"), on(F.add_months(F.to_date(now), -1))).when(this.isNotNull(), this))


def clock_time(c: Column, now: Column) -> Column:
    """"HH:MM" (the last one) or "HH:MM DD/MM" (this year or, if later than now, the last); now if it is neither."""
    clock = F.nullif(F.regexp_extract(c, "^\\s*(\\d{1,2}:\\d\\d)\\s*$", 1), F.lit(""))
    today = parse(F.concat_ws(" ", F.date_format(now, "yyyy-MM-dd"), F.lpad(clock, 5, "0")), "yyyy-MM-dd HH:mm")
    both = "^\\s*(\\d{1,2}:\\d\\d)\\s+(\\d{1,2})/(\\d{1,2})\\s*$"
    dated = F.when(c.rlike(both), F.concat_ws(" ", F.concat_ws("-", F.date_format(now, "yyyy"), F.lpad(F.regexp_extract(c, both, 3), 2, "0"), F.lpad(F.regexp_extract(c, both, 2), 2, "0")), F.lpad(F.regexp_extract(c, both, 1), 5, "0")))
    year = parse(dated, "yyyy-MM-dd HH:mm")
    year = F.when(year > now, F.add_months(F.to_date(year), -12).cast("timestamp_ntz") + (year - F.date_trunc("day", year).cast("timestamp_ntz"))).otherwise(year)
    return F.coalesce(F.when(clock.isNotNull(), F.when(today > now, today - F.expr("INTERVAL 1 DAY")).otherwise(today)), year, now)


def history_time(c: Column) -> Column:
    return parse(c, "dd/MM/yyyy HH:mm")


def tag_bound(c: Column, end: bool) -> Column:
    """A tag's start or end: with seconds, with minutes, with a T, or a date alone, which means its first or last second."""
    text = F.trim(c)
    day = parse(F.when(F.length(text) == 10, text), "yyyy-MM-dd")
    return F.coalesce(parse(text, "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm"), day + F.expr("INTERVAL 86399 SECONDS") if end else day)


def join_date_time(day: Column, clock: Column) -> Column:
    """A date and an optional HH:MM[:SS] as one timestamp, null if either is invalid."""
    return parse(F.concat_ws(" ", day, F.coalesce(F.nullif(F.trim(clock), F.lit("")), F.lit("00:00"))), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(60e6)


def age_minutes(then: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), minutes_between(then, now)) if then is not None else F.lit(None).cast("double")


def describe_age(minutes: Column) -> Column:
    """never, just now, "4 min ago", "2 hr 10 min ago"."""
    n = F.rint(minutes).cast("long")
    hours, rest = F.floor(n / 60), F.pmod(n, F.lit(60))
    long = F.when(rest > 0, F.format_string("%d hr %d min ago", hours, rest)).otherwise(F.format_string("%d hr ago", hours))
    return F.when(minutes.isNull(), "never").when(minutes < 1, "just now").when(minutes < 90, F.format_string("%d min ago", n)).otherwise(long)


def duration(minutes: Column) -> Column:
    """"2d 3h", "4h 00m" or "45m"."""
    n = F.floor(minutes).cast("long")
    days, hours, rest = F.floor(n / 1440), F.floor(F.pmod(n, F.lit(1440)) / 60), F.pmod(n, F.lit(60))
    return F.when(days > 0, F.format_string("%dd %dh", days, hours)).when(hours > 0, F.format_string("%dh %02dm", hours, rest)).otherwise(F.format_string("%dm", rest))


def outage_minutes(start: Column, end: Column) -> Column:
    """Whole minutes, halves up."""
    return F.round(F.timestamp_diff("SECOND", start, end) / 60)


def window_label(minutes: int) -> str:
    return WINDOWS.get(minutes, f"{minutes} minutes")


def marks(start: Column, end: Column) -> Column:
    """About eight slider marks, some multiple of five minutes apart."""
    step = F.greatest(F.lit(5), F.ceil(minutes_between(start, end) / 8 / 5) * 5).cast("int")
    return F.sequence(start, end, F.make_dt_interval(mins=step))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
