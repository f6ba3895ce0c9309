"""What stands around a place: roads, outages, gauges in flood and fires near it, as figures and as lines of a report.

All layers go into one table of places, rows at one place added up, and the places asked about meet it once on a grid.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import classify, text
from tidewatch.operators import spatial
from tidewatch.operators.temporal import with_previous

LAYER = ["layer", "lat", "lon", "amount", "grade", "level"]
FIGURES = ["roads", "closures", "outages", "customers", "gauges", "fires", "warnings", "grade", "level"]


def placed(outages: DataFrame, cache: DataFrame) -> DataFrame:
    """Open outages (location, customers_off, restored) with the place (lat, lon) of their location, those that have one."""
    known = cache.where("lat IS NOT NULL").select("location", "lat", "lon")
    return outages.where("restored = 0").join(known, "location")


def standing(roads: DataFrame, outages: DataFrame, gauges: DataFrame, fires: DataFrame) -> DataFrame:
    """LAYER rows of what holds now.

    roads: lat, lon, is_closure, resolved; outages: of `placed`; gauges: lat, lon, priority; fires: lat, lon, feed_type,
    warning_level, resolved (burnt areas and rows without a type don't count).
    """
    def layer(rows: DataFrame, name: str, amount: Column, grade: Column | None = None, level: Column | None = None) -> DataFrame:
        null = F.lit(None)
        return rows.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.lit(name).alias("layer"), "lat", "lon", F.coalesce(amount.cast("double"), F.lit(0.0)).alias("amount"), (null if grade is None else grade).cast("int").alias("grade"), (null if level is None else level).cast("string").alias("level"))

    warning = F.col("feed_type") == "warning"
    level = F.when(warning, F.trim("warning_level"))
    return reduce(DataFrame.unionByName, [
        layer(roads.where("resolved = 0"), "roads", F.col("is_closure")),
        layer(outages, "outages", F.col("customers_off")),
        layer(gauges.where("priority < 4"), "gauges", F.lit(0)),
        layer(fires.where("resolved = 0 AND feed_type <> 'burn-area'"), "fires", warning.cast("int"), classify.warning_order(level), level),
    ])


def surroundings(points: DataFrame, layers: DataFrame, km: float = 10.0) -> DataFrame:
    """points (lat, lon and more) with FIGURES of what LAYER rows lie within km; level is the gravest warning's (the first by name).

    Points without coordinates have nothing around them. Points and rows at one place are taken together first, so a town
    with very many of either is one pair.
    """
    best = F.min(F.when(F.col("grade").isNotNull(), F.struct("grade", "level")))
    places = layers.groupBy("layer", "lat", "lon").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), best.alias("best"))
    asked = points.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct()
    pairs = spatial.radius_join(asked, places, km)
    on = lambda name, what: F.coalesce(F.sum(F.when(F.col("layer") == name, F.col(what))), F.lit(0)).cast("long")
    figures = pairs.groupBy("lat", "lon").agg(
        on("roads", "n").alias("roads"), on("roads", "amount").alias("closures"), on("outages", "n").alias("outages"), on("outages", "amount").alias("customers"),
        on("gauges", "n").alias("gauges"), on("fires", "n").alias("fires"), on("fires", "amount").alias("warnings"), F.min("best").alias("best"),
    )
    figures = figures.select("lat", "lon", *FIGURES[:-2], F.col("best.grade").alias("grade"), F.col("best.level").alias("level"))
    return points.join(figures, ["lat", "lon"], "left").fillna(0, FIGURES[:-2]).select(*points.columns, *FIGURES)


def nearby_lines(hazard: Column, km: float) -> Column:
    """Lines of what FIGURES say, without a flood's gauges and a fire's incidents."""
    c = F.col
    within = F.lit(f" within {km:g} km")
    roads = F.concat(text.plural(c("roads"), "road disruption"), F.when(c("closures") > 0, F.concat(F.lit(" ("), text.plural(c("closures"), "full closure"), F.lit(")"))).otherwise(""), within)
    outages = F.concat(text.plural(c("outages"), "power outage"), F.lit(" nearby — "), text.number(c("customers").cast("double")), F.lit(" customers off"))
    gauges = F.concat(text.plural(c("gauges"), "gauge"), F.lit(" at or above minor flood level"), within)
    fires = F.concat(text.plural(c("fires"), "active incident"), F.when(c("warnings") > 0, F.concat(F.lit(", "), c("warnings").cast("string"), F.lit(" under warning"))).otherwise(""), within)
    other = lambda name: ~F.coalesce(hazard == name, F.lit(False))
    return F.array_compact(F.array(F.when(c("roads") > 0, roads), F.when(c("outages") > 0, outages), F.when(other("flood") & (c("gauges") > 0), gauges), F.when(other("fire") & (c("fires") > 0), fires)))


def own_warning(hazard: Column, metric: Column) -> Column:
    """"Watch and Act remains current": the gravest warning near a fire's entry that isn't about a warning level itself."""
    fire = (hazard == "fire") & ~F.coalesce(metric == "warning_level", F.lit(False))
    return F.when(fire & F.col("level").isNotNull(), F.concat("level", F.lit(" remains current")))


def feed(entries: DataFrame, layers: DataFrame, start: Column, end: Column, *, hazards: list[str] | None = None, least: int = classify.INFO, limit: int = 120, context_limit: int = 40, km: float = 10.0) -> DataFrame:
    """(position and the columns of entries, lines): the newest entries of a window, the first of them with what stands around.

    entries: id, ts, hazard, severity, entity_name, metric, prev_value, new_value, prev_label, new_label, unit, since, rate,
    lat, lon. Lines are the change, its rate, the warning that holds, and what is near.
    """
    rows = entries.where(F.col("ts").between(start, end) & (F.col("severity") >= least))
    if hazards is not None:
        rows = rows.where(F.col("hazard").isin(hazards))
    newest = rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    # there are `limit` rows by now
    listed = newest.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), (-F.col("id")).alias("b"), F.struct(*entries.columns).alias("e")))).alias("all"))
    placed_rows = listed.select(F.posexplode("all").alias("position", "x")).select("position", "x.e.*")
    around = surroundings(placed_rows, layers, km)
    delta = text.delta_line(F.col("entity_name"), F.col("prev_value"), F.col("new_value"), F.col("prev_label"), F.col("new_label"), F.col("unit"), F.col("since"))
    first = F.col("position") < context_limit
    own = F.array_compact(F.array(delta, text.blank_to_null(F.col("rate")), F.when(first, own_warning(F.col("hazard"), F.col("metric")))))
    lines = F.when(first, F.concat(own, nearby_lines(F.col("hazard"), km))).otherwise(own)
    return around.select("position", *entries.columns, lines.alias("lines"))


def positions(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """changes (hazard, headline and more) with lat and lon of the newest stored entry (hazard, headline, ts, seq, lat, lon) that has a place."""
    known = stored.where("lat IS NOT NULL").groupBy("hazard", "headline").agg(F.max_by(F.struct("lat", "lon"), F.struct("ts", "seq")).alias("_at"))
    return changes.join(known, ["hazard", "headline"], "left").select(*changes.columns, F.col("_at.lat").alias("lat"), F.col("_at.lon").alias("lon"))


def consequences(changes: DataFrame, stored: DataFrame, layers: DataFrame, *, least: int = classify.MAJOR, km: float = 10.0, limit: int = 6) -> DataFrame:
    """(position, title, hazard, lines): places where grave changes of two hazards or more came together, the gravest first.

    changes: event_id, hazard, severity, ts, headline, entity_name of one window. A change joins the first place whose
    anchor is within km, in order of severity and then the newest; a place's lines are its headlines, in that order, and
    what stands around the anchor, all hazards included.
    """
    rows = positions(changes.where(F.col("severity") >= least), stored).where("lat IS NOT NULL AND lon IS NOT NULL").withColumn("_window", F.lit(0))
    found = spatial.clusters(rows, km, day="_window").select("event_id", "cluster_id")
    order = F.struct((-F.col("severity")).alias("a"), F.col("ts").isNull().alias("b"), (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("c"), F.col("event_id").alias("d"))
    members = rows.withColumn("_order", order).join(found, "event_id")
    # an anchor is the first of its place
    anchors = members.where("event_id = cluster_id").orderBy("_order").limit(limit)
    listed = anchors.groupBy().agg(F.sort_array(F.collect_list(F.struct("_order", "cluster_id", "hazard", "headline", "entity_name", "lat", "lon"))).alias("all"))
    places = listed.select(F.posexplode("all").alias("position", "x")).select("position", "x.*").drop("_order")
    headlines = members.join(places.select("cluster_id"), "cluster_id", "left_semi").groupBy("cluster_id", "headline").agg(F.min("_order").alias("o"))
    headlines = headlines.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "headline"))), lambda x: x["headline"]).alias("said"))
    around = surroundings(places, layers, km).join(headlines, "cluster_id")
    lines = F.array_distinct(F.concat("said", nearby_lines(F.lit(""), km)))
    return around.select("position", F.coalesce(text.blank_to_null(F.col("entity_name")), F.col("headline")).alias("title"), "hazard", lines.alias("lines"))


def window_totals(steps: DataFrame, asked: DataFrame, hours: int) -> DataFrame:
    """(wmo, at, total, readings): what a counter grew by within so many hours before each asked (wmo, at), restarts allowed for.

    steps: readings (wmo, ts, seq, value) with `step`, the growth since the one before. A window's first reading is its
    baseline, so the total is the sum of its steps but for that one's; windows of one reading have no total.
    """
    since = F.col("at") - F.make_dt_interval(hours=F.lit(hours))
    days = asked.distinct().withColumn("_since", since).withColumn("_day", F.explode(F.sequence(F.to_date("_since"), F.to_date("at"))))
    rows = days.join(steps.withColumn("_day", F.to_date("ts")), ["wmo", "_day"]).where("ts >= _since AND ts <= at")
    total = F.sum("step") - F.min_by("step", F.struct("ts", "seq"))
    return rows.groupBy("wmo", "at").agg(total.alias("total"), F.count("*").alias("readings")).where("readings >= 2")


def catchment_rainfall(gauges: DataFrame, instants: DataFrame, stations: DataFrame, readings: DataFrame, *, km: float = 50.0, hours: int = 24) -> DataFrame:
    """(station, at, max_mm, wettest, stations): rain near each gauge before each instant: the wettest station's total, not the mean.

    gauges: station, lat, lon; stations: wmo, lat, lon; readings: wmo, ts, seq, rain. Of equal totals the nearest station
    counts, then the first; totals and km are equal if they are to six places, as sums depend on their order. Gauges
    without a station in range, or none that reported twice, are absent.

    Stations at one place are taken together before places meet, so only places multiply.
    """
    sites = stations.where("lat IS NOT NULL AND lon IS NOT NULL")
    places = spatial.radius_join(gauges.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct(), sites.select("lat", "lon").distinct(), km)
    near = sites.join(places.select(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon")).distinct(), ["lat", "lon"], "left_semi").select("wmo", "lat", "lon")
    known = readings.where("rain IS NOT NULL").join(near.select("wmo").distinct(), "wmo", "left_semi")
    grown = F.when(F.col("rain") >= F.col("prev_rain"), F.col("rain") - F.col("prev_rain")).when(F.col("prev_rain").isNotNull(), F.col("rain")).otherwise(0.0)
    steps = with_previous(known.select("wmo", "ts", "seq", "rain"), ["wmo"], "ts", "seq", ["rain"]).withColumn("step", grown)
    asked = near.select("wmo").distinct().crossJoin(F.broadcast(instants.select("at").distinct()))
    totals = window_totals(steps, asked, hours)
    first = F.struct((-F.round("total", 6)).alias("t"), "wmo")
    held = near.join(totals, "wmo").groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "at").agg(F.max("total").alias("total"), F.min(first).alias("first"), F.count("*").alias("n"))
    order = F.struct(F.col("first.t"), F.round("km", 6).alias("km"), F.col("first.wmo"))
    figures = places.join(held, ["r_lat", "r_lon"]).groupBy("lat", "lon", "at").agg(F.max("total").alias("max_mm"), F.min(order)["wmo"].alias("wettest"), F.sum("n").alias("stations"))
    return gauges.join(figures, ["lat", "lon"]).select("station", "at", "max_mm", "wettest", "stations")
