"""Which station a guide's text speaks of, and what the guide says of heights there.

A station is named by a river and the words of a place on it. Texts are searched for these as they are, so that a name
may be part of a longer word. An inverted index of words proposes the candidates, and only these texts are searched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text
from tidewatch.functions.shared import written

#: Words of a station's place that don't tell it from others.
LOC_STOPWORDS = ["weir", "reservior", "reservoir", "upstream", "downstream", "hg", "tw", "st", "street", "hwy", "highway", "bridge", "rd", "road", "ave", "gauge", "wharf", "town", "the", "at", "d", "s", "u", "east", "west", "north", "south", "marina", "retarding", "basin", "flinders", "melville"]
#: Phrases of sentences that aren't about a height, and headings at which an impact ends.
BOILERPLATE = ["floodwater can", "warning means", "vicemergency app", "flood warning means", "emergency.vic.gov.au"]
TRAILING = "(?i)\\s*(?:2012 flood observations|The following table provide).*$"
#: Letters of a river's name at least, and of the n-grams at most.
LEAST, GRAM = 4, 4
CLASSES = ["minor", "moderate", "major"]


def stations(rows: DataFrame) -> DataFrame:
    """(seq, name, norm, river, tokens, minor, moderate, major) of stations (seq, name and levels); of equal names the first by seq.

    What stands before the first " at " is the river, the words after it, those of three letters and more that aren't
    common, the place.
    """
    named = rows.withColumn("name", text.blank_to_null(F.col("name"))).where("name IS NOT NULL")
    first = named.groupBy(F.lower("name").alias("_key")).agg(F.min_by(F.struct("seq", "name", *CLASSES), "seq").alias("s")).select("s.*")
    norm = text.plain(F.col("name"))
    at = F.instr("norm", " at ")
    place = F.when(at > 0, F.substr("norm", at + 4)).otherwise("")
    words = F.filter(F.split(place, " "), lambda x: (F.length(x) >= 3) & ~x.isin(LOC_STOPWORDS))
    return first.withColumn("norm", norm).select("seq", "name", "norm", F.trim(F.substring_index("norm", " at ", 1)).alias("river"), words.alias("tokens"), *CLASSES)


def candidates(contexts: DataFrame, known: DataFrame) -> DataFrame:
    """(context, seq): stations (of `stations`) that normalised texts (context, text) speak of.

    The text has the river's name, and any word of the place or, if the place has none, the station's whole name. Contexts
    are rows with an identity of their own; null texts speak of nothing.

    Each word of a river stands within one word of the text. So the distinct words of all texts are held against those of
    the rivers, by n-grams of letters, and of each river only the word that the fewest texts have proposes pairs.
    """
    words = written(contexts.where("text IS NOT NULL").select("context", F.explode(F.array_distinct(F.split("text", " "))).alias("word")), "words")
    rivers = known.where(F.length("river") >= LEAST).select("seq", F.explode(F.array_distinct(F.split("river", " "))).alias("needle"))
    needles = rivers.select("needle", F.left("needle", F.lit(GRAM)).alias("gram")).distinct()
    grams = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("word", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, GRAM + 1)])))
    vocabulary = words.groupBy("word").agg(F.count("*").alias("n"))
    held = vocabulary.select("word", "n", F.explode(grams).alias("gram")).join(needles, "gram").where(F.contains("word", F.col("needle"))).select("needle", "word", "n")
    held = written(held, "held")
    counts = held.groupBy("needle").agg(F.sum("n").alias("n"))
    rare = rivers.join(counts, "needle", "left").groupBy("seq").agg(F.min_by("needle", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "needle")).alias("needle"))
    pairs = words.join(held.join(rare, "needle").select("word", "seq"), "word").select("context", "seq").distinct()
    # a text meets all its candidates at once
    asked = pairs.join(known.select("seq", "norm", "river", "tokens"), "seq").groupBy("context").agg(F.collect_list(F.struct("seq", "norm", "river", "tokens")).alias("s"))

    def named(s: Column) -> Column:
        place = F.when(F.size(s["tokens"]) > 0, F.exists(s["tokens"], lambda t: F.contains("text", t))).otherwise(F.contains(F.col("text"), s["norm"]))
        return F.contains(F.col("text"), s["river"]) & place

    return asked.join(contexts, "context").select("context", F.explode(F.transform(F.filter("s", named), lambda s: s["seq"])).alias("seq"))


def best_station(units: DataFrame, contexts: DataFrame, known: DataFrame, *, tolerance: float = 0.15) -> DataFrame:
    """(unit, seq, step, score): the station that each unit (a table of a guide) is about; units without one are absent.

    units: unit, file, minor, moderate, major (levels its own rows give); contexts: unit, step, page, text: texts to look
    in, in order of step; `page` if the text stands with the unit. The first text that speaks of any station decides, and
    there the highest score: four for each level that agrees, two for the place's first word in the file's name, three for
    any, one for a text of the unit's page. Of equal scores the station first by seq wins.
    """
    # there are a few steps; each looks at those units only that no text before it decides, and its texts are tidied once
    steps = sorted(r[0] for r in contexts.where("step IS NOT NULL").select("step").distinct().collect())
    found, rest = [], contexts
    for k in steps:
        texts = rest.where(F.col("step") == k).select(F.struct("unit", "step").alias("context"), "page", text.plain(F.col("text")).alias("text"))
        texts = written(texts, "texts")
        named = candidates(texts.select("context", "text"), known).join(texts.select("context", "page"), "context")
        found.append(written(named.select("context.unit", "context.step", "page", "seq"), "named"))
        rest = rest.join(found[-1].select("unit").distinct(), "unit", "left_anti")
    none = contexts.limit(0).select("unit", "step", "page").join(known.limit(0).select("seq"), F.lit(True))
    rows = reduce(DataFrame.unionByName, found, none)
    rows = rows.join(units.select("unit", text.plain(F.col("file")).alias("file"), *[F.col(c).alias(f"_{c}") for c in CLASSES]), "unit")
    rows = rows.join(known.select("seq", "tokens", *CLASSES), "seq")
    agree = sum((F.coalesce((F.abs(F.col(f"_{c}") - F.col(c)) <= tolerance).cast("int"), F.lit(0)) for c in CLASSES), F.lit(0))
    one, any_ = (F.coalesce(x, F.lit(False)).cast("int") for x in (F.contains("file", F.get("tokens", F.lit(0))), F.exists("tokens", lambda t: F.contains("file", t))))
    rows = rows.withColumn("score", 4 * agree + 2 * one + 3 * any_ + F.col("page").cast("int"))
    return rows.groupBy("unit").agg(F.min_by(F.struct("seq", "step", "score"), F.struct((-F.col("score")).alias("s"), "seq")).alias("b")).select("unit", "b.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """(unit, n, height_m, impact): heights in a page's text (unit, text) and what the lines after each say.

    A line that is a height in metres begins a row, one that is only a number corrects a height that has no text yet;
    heights above the datum are skipped. Rows without text don't count.
    """
    number = "^\\s*(\\d{1,3}(?:\\.\\d{1,3})?)\\s*"
    metres, bare, datum = f"(?i){number}(?:m\\b|metres?\\b)\\s*(?:or)?\\s*[*^~#]?\\s*$", f"{number}$", "(?i)^\\s*\\d{1,3}(?:\\.\\d{1,3})?\\s*m?\\s*AHD\\s*$"
    row = "struct<height:double,impact:string>"
    start = F.struct(F.array().cast(f"array<{row}>").alias("rows"), F.lit(None).cast("double").alias("height"), F.lit("").alias("impact"))

    def step(s: Column, line: Column) -> Column:
        done = F.when(s["impact"] != "", F.array_append(s["rows"], F.struct(s["height"].alias("height"), s["impact"].alias("impact")))).otherwise(s["rows"])
        begin = F.struct(done.alias("rows"), F.regexp_extract(line, metres, 1).cast("double").alias("height"), F.lit("").alias("impact"))
        correct = F.struct(s["rows"].alias("rows"), F.regexp_extract(line, bare, 1).cast("double").alias("height"), F.lit("").alias("impact"))
        more = F.struct(s["rows"].alias("rows"), s["height"].alias("height"), F.ltrim(F.concat(s["impact"], F.lit(" "), F.trim(line))).alias("impact"))
        open_ = s["height"].isNotNull()
        return F.when(line.rlike(datum), s).when(line.rlike(metres), begin).when(line.rlike(bare) & open_ & (s["impact"] == ""), correct).when(open_ & (F.trim(line) != ""), more).otherwise(s)

    done = lambda s: F.when(s["impact"] != "", F.array_append(s["rows"], F.struct(s["height"].alias("height"), s["impact"].alias("impact")))).otherwise(s["rows"])
    rows = pages.where("text IS NOT NULL").select("unit", F.posexplode(F.aggregate(F.split("text", "\r?\n"), start, step, done)).alias("n", "r"))
    return rows.select("unit", "n", F.col("r.height").alias("height_m"), F.col("r.impact").alias("impact"))


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows of `page_rows` with tidied impacts, without sentences that aren't about a height and heights out of range."""
    impact = F.trim(F.regexp_replace(F.regexp_replace("impact", "\\s+", " "), TRAILING, ""))
    rows = rows.withColumn("impact", impact).where(F.col("height_m").between(0.1, 150) & (F.length("impact") >= 4))
    low = F.lower("impact")
    for phrase in BOILERPLATE:
        rows = rows.where(~F.contains(low, F.lit(phrase)))
    return rows.withColumn("height_m", F.round("height_m", 2))


def levels(rows: DataFrame) -> DataFrame:
    """(unit, minor, moderate, major): the heights that a unit's rows name as its flood levels, the first of each."""
    kind = F.lower(F.regexp_extract("impact", "(?i)^\\W*(minor|moderate|major)\\s+flood\\s+level\\b", 1))
    return rows.withColumn("_kind", kind).groupBy("unit").agg(*[F.min_by("height_m", F.when(F.col("_kind") == c, F.col("n"))).alias(c) for c in CLASSES])


def impacts(rows: DataFrame, best: DataFrame) -> DataFrame:
    """(seq, height_m, impact) of every station: the rows of all units about it, one for each height and beginning of the text (40 letters)."""
    both = rows.join(best.select("unit", "seq"), "unit")
    key = F.lower(F.left("impact", F.lit(40)))
    return both.groupBy("seq", "height_m", key.alias("_key")).agg(F.min_by("impact", F.struct("unit", "n")).alias("impact")).drop("_key")
