"""Text: names, keys, lenient numbers, wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What feeds write for a missing reading.
MISSING = ["", "-", "--", "n/a", "na"]
#: Words that separate a town from its stream in gauge names, in the order in which they are tried.
SPLITTERS = [" downstream of ", " upstream of ", " at "]

#: Words of gauge names that say nothing of the place: kinds of water, structures and their abbreviations.
STOP = ["at", "river", "creek", "ck", "r", "rv", "crk", "cr", "riv", "ri", "lake", "lk", "drain", "channel", "chl", "weir", "br", "bridge", "d", "u", "us", "ds"]


def norm_key(c: Column) -> Column:
    """A key as it is compared: outer white space of any kind off, lower case."""
    return F.lower(F.regexp_replace(c, "^\\s+|\\s+$", ""))


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def clean(c: Column) -> Column:
    """Trimmed text; null for a missing marker."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin(MISSING), text)


def to_double(c: Column) -> Column:
    """A number, or null; NaN and infinities are no numbers."""
    number = c.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def to_int(c: Column) -> Column:
    """A whole number with thousands commas, or null."""
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("int")


def value_time(c: Column) -> Column:
    """struct(value, time) of a daily extreme and the time run into it: "4602:40pm" is 46 at 02:40pm."""
    text = clean(c)
    pattern = "^(-?[0-9]+(?:\\.[0-9]+)?)([0-9]{2}:[0-9]{2}[ap]m)$"
    value = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)
    return F.struct(to_double(value).alias("value"), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).alias("time"))


def hectares(c: Column) -> Column:
    """The number before "ha" in free text, or null."""
    return to_double(F.nullif(F.replace(F.regexp_extract(c, "(?i)([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*ha", 1), F.lit(","), F.lit("")), F.lit("")))


def gauge_town(name: Column) -> Column:
    """The town in a gauge's name: what follows the last occurrence of the first splitter that occurs, without gauge codes."""
    town = F.lit(None).cast("string")
    for splitter in reversed(SPLITTERS):
        town = F.when(F.contains(name, F.lit(splitter)), F.substring_index(name, splitter, -1)).otherwise(town)
    town = F.regexp_replace(F.regexp_replace(town, "\\s*\\([^)]*\\)\\s*$", ""), "\\s+(HG|TW|H\\.G\\.|T\\.W\\.)\\s*$", "")
    return blank_to_null(town)


def split_type(c: Column) -> Column:
    """struct(primary, sub) at the first comma and blank; a blank primary is Unspecified."""
    at = F.instr(c, ", ")
    primary = F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c)
    sub = F.when(at > 0, F.substr(c, at + 2))
    return F.struct(F.coalesce(blank_to_null(primary), F.lit("Unspecified")).alias("primary"), blank_to_null(sub).alias("sub"))


def place(c: Column) -> Column:
    """The short place name of a location."""
    text = F.trim(F.coalesce(c, F.lit("")))
    short = F.when(F.contains(text, F.lit(" - ")), F.substring_index(text, " - ", 1)).otherwise(F.substring_index(text, ", ", 1))
    return F.coalesce(blank_to_null(F.trim(short)), F.when(text == "", F.lit("Unknown location")), F.lit(""))


def pretty(c: Column) -> Column:
    """flood_warning as Flood Warning."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def flat_list(c: Column) -> Column:
    """A list as comma-separated text without its empty items."""
    return F.nullif(F.array_join(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")), ", "), F.lit(""))


def safe_name(c: Column) -> Column:
    """A file name: other characters than letters, digits, - and _ as _; "export" if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(c), "[^A-Za-z0-9_-]+", "_"), F.lit("")), F.lit("export"))


def tokens(c: Column, stop: list[str]) -> Column:
    """Lower-case words, "@" read as "at", without stop words; order and repeats stay."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("@"), F.lit(" at "))), "[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda x: (x != "") & ~x.isin(stop)) if stop else F.filter(parts, lambda x: x != "")


def plain(c: Column) -> Column:
    """Lower case, without apostrophes, other signs as single blanks."""
    # blanks that stand alone, which most are, stay as they are
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "['\u2019]", ""), " *+[^a-z0-9 ][^a-z0-9]*+|  +", " "))


def town_of_file(c: Column) -> Column:
    """The town in a guide's file name: its stem without the guide's own words."""
    stem = F.regexp_replace(F.regexp_replace(c, "^.*/", ""), "\\.[A-Za-z]+$", "")
    return blank_to_null(F.regexp_replace(F.regexp_replace(stem, "(?i)(local|flood|guide|information)", " "), "[_\\s-]+", " "))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def shorten(c: Column, most: int = 110) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.left(c, F.lit(most - 1))), F.lit("…"))).otherwise(c)


def quote_path(c: Column) -> Column:
    """Percent-encoded, with / as it is and blanks as %20."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def unquote_path(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def number(c: Column, places: int | None = None) -> Column:
    """A number as people write it: thousands commas, no idle zeros; "?" for null."""
    if places is not None:
        return F.coalesce(F.format_number(c, places), F.lit("?"))
    whole = F.abs(c - F.rint(c)) < 1e-9
    short = F.regexp_replace(F.format_number(c, 2), "\\.?0+$", "")
    return F.coalesce(F.when(whole, F.format_number(F.rint(c), 0)).otherwise(short), F.lit("?"))


def count_text(c: Column) -> Column:
    return F.coalesce(F.format_number(c.cast("long"), 0), F.lit("—"))


def measured(c: Column, places: int, unit: str = "") -> Column:
    """A number with its unit, "—" for null."""
    gap = "" if unit in ("", "%") else " "
    return F.when(c.isNotNull(), F.concat(F.format_string(f"%.{places}f", c.cast("double")), F.lit(gap + unit))).otherwise("—")


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or f"{one}s"))


def rate_text(rate: Column) -> Column:
    """Rising or Falling with m/hr, Steady below 0.01, null for null."""
    word = F.when(rate > 0, "Rising").otherwise("Falling")
    return F.when(F.abs(rate) < 0.01, F.lit("Steady")).when(rate.isNotNull(), F.concat(word, F.format_string(" %.2f m/hr", F.abs(rate).cast("double"))))


def growth_text(before: Column, after: Column, hours: Column) -> Column:
    """"+N ha/hr" where a quarter of an hour or more lies between; null where an area is unknown."""
    return F.when((hours >= 0.25) & (after - before).isNotNull(), F.format_string("+%.0f ha/hr", ((after - before) / hours).cast("double")))


def wind_text(direction: Column, kmh: Column) -> Column:
    calm = (kmh == 0) | (F.upper(direction) == "CALM")
    text = F.concat_ws(" ", blank_to_null(direction), F.format_string("%.0f km/h", kmh.cast("double")))
    return F.when(calm, F.lit("Calm")).when(kmh.isNotNull(), text)


def delta_line(name: Column, before: Column, after: Column, before_label: Column, after_label: Column, unit: Column, since: Column) -> Column:
    """"Name: a → b unit since HH:MM" of whatever is known; null where no value and no label is."""
    show = lambda v: F.when(unit == "m", number(v, 2)).otherwise(number(v))
    tail = F.rtrim(F.concat(F.lit(" "), F.coalesce(unit, F.lit(""))))
    body = (
        F.when(before.isNotNull() & after.isNotNull(), F.concat(show(before), F.lit(" → "), show(after), tail))
        .when(after.isNotNull(), F.concat(show(after), tail))
        .when(before_label.isNotNull() & after_label.isNotNull(), F.concat(before_label, F.lit(" → "), after_label))
        .otherwise(after_label)
    )
    body = F.concat(body, F.coalesce(F.concat(F.lit(" since "), F.date_format(since, "HH:mm")), F.lit("")))
    return F.when(blank_to_null(name).isNotNull(), F.concat(F.trim(name), F.lit(": "), body)).otherwise(body)
