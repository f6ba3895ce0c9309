"""Feeds: HTML tables, GeoJSON, paged JSON, CSV, nested JSON. Every reader gives typed rows; what doesn't parse is null."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import classify, geo, text, times

#: Suffixes of header ids that name a weather field, with the field's column and kind.
FIELDS = {
    "-temp": ("temperature_c", "float"), "-apptmp": ("apparent_temperature_c", "float"), "-dewpoint": ("dew_point_c", "float"), "-relhum": ("relative_humidity_pct", "float"), "-delta-t": ("delta_t_c", "float"),
    "-wind-dir": ("wind_direction", "text"), "-wind-spd-kph": ("wind_speed_kmh", "float"), "-wind-gust-kph": ("wind_gust_kmh", "float"), "-press": ("pressure_msl_hpa", "float"), "-rainsince9am": ("rain_since_9am_mm", "float"),
    "-wind-gust-dir": ("max_gust_direction", "text"), "-gust-max-kph": ("max_gust_kmh", "value_time"), "-datetime": ("obs_time", "day_time"),
}


class _Rows(HTMLParser):
    """Table rows and list items as lists of (tag, headers, href, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.tables: list[int] = []
        self.table = 0
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.table += 1
        if tag in ("tr", "li") or (tag in ("td", "th") and not self.rows):
            self.rows.append([])
            self.tables.append(self.table)
        if tag in ("td", "th", "li"):
            self.cell = {"tag": tag, "headers": a.get("headers"), "href": None, "text": ""}
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None:
            self.cell["href"] = a.get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "li", "tr", "table", "ul"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


CELLS = "array<struct<tag:string,headers:string,href:string,text:string>>"


def html_rows(pages: DataFrame, id: str, html: str) -> DataFrame:
    """(id, table, row, cells): every table row and list item of every page, with the number of the table last begun; null pages have none."""
    import pyarrow as pa

    source = pages.select(F.col(id).cast("string").alias("id"), F.col(html).alias("html"))
    cell = pa.struct([(k, pa.string()) for k in ("tag", "headers", "href", "text")])

    def run(batches):
        for batch in batches:
            ids, tables, ks, cells = [], [], [], []
            for i, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = _Rows()
                parser.feed(page or "")
                for k, (t, row) in enumerate((t, r) for t, r in zip(parser.tables, parser.rows, strict=True) if r):
                    ids.append(i)
                    tables.append(t)
                    ks.append(k)
                    cells.append([{**c, "text": " ".join(c["text"].split())} for c in row])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(tables, pa.int32()), pa.array(ks, pa.int32()), pa.array(cells, pa.list_(cell))], names=["id", "table", "row", "cells"])

    return source.mapInArrow(run, f"id string, table int, row int, cells {CELLS}")


def weather_rows(pages: DataFrame, now: Column, *, id: str = "page_id", html: str = "html") -> DataFrame:
    """One row for each station of an observation page: fields by the suffixes of their cells' header ids, in any column order.

    Rows without a station link or an observation time go; a field that doesn't parse is null and spoils nothing else.
    """
    rows = html_rows(pages, id, html)
    href = F.array_join(F.transform("cells", lambda c: F.coalesce(c["href"], F.lit(""))), " ")
    rows = rows.withColumn("wmo", F.nullif(F.regexp_extract(href, "\\.(\\d{5})\\.shtml", 1), F.lit(""))).where("wmo IS NOT NULL")
    longest = sorted(FIELDS, key=len, reverse=True)

    def cell(suffix: str) -> Column:
        longer = [s for s in longest if len(s) > len(suffix) and s.endswith(suffix)]
        mine = lambda c: F.endswith(c["headers"], F.lit(suffix)) & ~F.coalesce(F.array_contains(F.array(*[F.endswith(c["headers"], F.lit(s)) for s in longer]), True) if longer else F.lit(False), F.lit(False))
        return F.try_element_at(F.filter("cells", mine), F.lit(1))["text"]

    out = [F.col("wmo"), F.filter("cells", lambda c: c["href"].isNotNull())[0]["text"].alias("name")]
    for suffix, (name, kind) in FIELDS.items():
        raw = cell(suffix)
        if kind == "float":
            out.append(text.to_double(text.clean(raw)).alias(name))
        elif kind == "text":
            out.append(text.clean(raw).alias(name))
        elif kind == "day_time":
            out.append(times.day_time(raw, now).alias(name))
        else:
            v = text.value_time(raw)
            out += [v["value"].alias(name), v["time"].alias("max_gust_time")]
    return rows.select(*out).where("obs_time IS NOT NULL")


def gauge_rows(pages: DataFrame, now: Column, *, id: str = "page_id", html: str = "html") -> DataFrame:
    """(page, catchment, station_name, height_m, tendency, classification, timestamp): cells by position; a row of one header names what follows."""
    rows = html_rows(pages, id, html)
    label = F.when((F.size("cells") == 1) & (F.col("cells")[0]["tag"] == "th"), F.col("cells")[0]["text"])
    from pyspark.sql.window import Window

    # one page is one group: pages are bounded, tables of pages aren't
    rows = rows.withColumn("catchment", F.last(label, ignorenulls=True).over(Window.partitionBy("id").orderBy("row")))
    at = lambda k: F.try_element_at("cells", F.lit(k + 1))["text"]
    data = rows.where((F.size("cells") > 1) & (F.col("cells")[0]["tag"] == "td"))
    return data.select(F.col("id").alias("page"), "catchment", text.clean(at(0)).alias("station_name"), text.to_double(text.clean(at(3))).alias("height_m"), text.clean(at(5)).alias("tendency"), text.clean(at(7)).alias("classification"), times.weekday_time(at(2), now).alias("timestamp")).where("station_name IS NOT NULL")


def history_rows(pages: DataFrame, *, id: str = "page_id", html: str = "html") -> DataFrame:
    """(page, timestamp, height_m) of a gauge's history page: its first table of five rows or more whose header speaks of a date.

    Rows without a time or a height are left out.
    """
    rows = html_rows(pages, id, html).where("table > 0")
    words = F.lower(F.array_join(F.transform("cells", lambda c: c["text"]), " "))
    tables = rows.groupBy("id", "table").agg(F.count("*").alias("n"), F.min_by(words, "row").alias("header"), F.min("row").alias("first")).where("n >= 5 AND header LIKE '%date%'")
    chosen = tables.groupBy("id").agg(F.min_by(F.struct("table", "first"), "table").alias("t")).select("id", "t.*")
    data = rows.join(chosen, ["id", "table"]).where("row > first AND size(cells) >= 2")
    data = data.select(F.col("id").alias("page"), times.history_time(F.col("cells")[0]["text"]).alias("timestamp"), text.to_double(text.clean(F.col("cells")[1]["text"])).alias("height_m"))
    return data.where("timestamp IS NOT NULL AND height_m IS NOT NULL")


def read_pages(spark: SparkSession, path: str, properties: str, *, limit: int = 0) -> DataFrame:
    """Features of a feed kept as one file for each page (a number in its name), as far as the feed goes.

    Without a limit a page is the whole feed, so the first counts. Else pages count up to the total their envelope
    names, or up to the first that holds fewer than `limit` features.
    """
    feature = f"struct<properties:{properties},geometry:string>"
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), "(\\d+)", 1).try_cast("int").alias("page")).where("page IS NOT NULL")
    inner = F.from_json("value", f"meta struct<total_pages:int>, features array<{feature}>, data struct<features:array<{feature}>>")
    pages = raw.select("page", F.coalesce(inner["data"]["features"], inner["features"], F.from_json("value", f"array<{feature}>")).alias("features"), inner["meta"]["total_pages"].alias("total"))
    last = F.least(F.min(F.when(F.col("total") > 0, F.col("total"))), F.min(F.when(F.coalesce("total", F.lit(0)) == 0, F.when(F.size("features") < limit, F.col("page"))))) if limit > 0 else F.min("page")
    upto = pages.agg(F.coalesce(last, F.max("page")).alias("last"))
    return pages.crossJoin(F.broadcast(upto)).where("page <= last").select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


WEATHER = "id string, type string, title string, short_title string, warning_group_type string, phase string, state string, issue_time string, expiry_time string"


def weather_warnings(rows: DataFrame, state: str, json: str = "value") -> DataFrame:
    """One row for each warning of a state in documents with a `data` list; times are local."""
    w = rows.select(F.explode(F.from_json(json, f"data array<struct<{', '.join(f.replace(' ', ':') for f in WEATHER.split(', '))}>>")["data"]).alias("w")).select("w.*")
    w = w.where((F.col("state") == state) & text.blank_to_null(F.col("id")).isNotNull())
    return w.select(F.col("id").alias("warning_id"), "type", "title", "short_title", F.col("warning_group_type").alias("group_type"), "phase", "state", times.iso_to_local(F.col("issue_time")).alias("issue_time"), times.iso_to_local(F.col("expiry_time")).alias("expiry_time"))


def warning_versions(details: DataFrame, json: str = "value") -> DataFrame:
    """(warning_id, issue_time, phase, title, message): a version for each detail document with an issue time, once each."""
    d = F.from_json(json, "data struct<id:string,issue_time:string,phase:string,title:string,message:string>")["data"]
    rows = details.select(d.alias("d")).select(F.col("d.id").alias("warning_id"), times.iso_to_local(F.col("d.issue_time")).alias("issue_time"), "d.phase", "d.title", "d.message")
    return rows.where("warning_id IS NOT NULL AND issue_time IS NOT NULL").groupBy("warning_id", "issue_time").agg(F.min(F.struct("phase", "title", "message")).alias("v")).select("warning_id", "issue_time", "v.*")


def rain_polls(observed: DataFrame, forecast: DataFrame, json: str = "value") -> DataFrame:
    """(location_key, rain_since_9am_mm, forecast_max_mm, forecast_chance) of documents by location: what fell, and the first day's forecast."""
    a = observed.select("location_key", F.from_json(json, "data struct<rain_since_9am:double>")["data"]["rain_since_9am"].alias("rain_since_9am_mm"))
    day = F.try_element_at(F.from_json(json, "data array<struct<rain:struct<amount:struct<max:double>,chance:double>>>")["data"], F.lit(1))["rain"]
    b = forecast.select("location_key", day["amount"]["max"].alias("forecast_max_mm"), day["chance"].alias("forecast_chance"))
    return a.join(b, "location_key", "full_outer")


def unknown_stations(seen: DataFrame, known: DataFrame, key: str, *, most: int = 25) -> DataFrame:
    """Keys without stored coordinates, in order, as many as one cycle asks for."""
    return seen.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti").orderBy(key).limit(most)


def new_frames(listed: DataFrame, stored: DataFrame, now: Column, *, minutes: int = 16) -> DataFrame:
    """Frames (radar_id, frame_ts) of the last minutes that aren't stored yet."""
    recent = listed.where(F.col("frame_ts").between(now - F.make_dt_interval(mins=F.lit(minutes)), now))
    return recent.join(stored.select("radar_id", "frame_ts"), ["radar_id", "frame_ts"], "left_anti")


def flood_csv(spark: SparkSession, path: str, names: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """read_csv's rows with an event: the file's own column, or the file's name without its ending."""
    raw = spark.read.csv(path, header=True, inferSchema=False).select("*", F.regexp_replace(text.unquote_path(F.col("_metadata.file_name")), "\\.[^.]*$", "").alias("_file")).withColumnsRenamed(names)
    event = F.coalesce(text.blank_to_null(F.col("event")), F.col("_file")) if "event" in raw.columns else F.col("_file")
    return raw.select(*[(F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items() if c != "event"], event.alias("event"))


def outage_csv(rows: DataFrame) -> DataFrame:
    """(location, customers_off, type, first_seen, last_seen, restored) of a tracker's CSV; restored is 1 for true and 1."""
    on = F.coalesce(F.lower(F.trim("restored")).isin("true", "1", "yes"), F.lit(False)).cast("int")
    stamp = lambda c: times.parse(F.col(c), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm").alias(c)
    return rows.select(text.blank_to_null(F.col("location")).alias("location"), text.to_int(F.col("customers_off")).alias("customers_off"), "type", stamp("first_seen"), stamp("last_seen"), on.alias("restored")).where("location IS NOT NULL")


def gauge_places(rows: DataFrame, json: str = "value") -> DataFrame:
    """(station_key, latitude, longitude, confidence, method) of a JSON map of gauges; those without coordinates go."""
    g = rows.select(F.explode(F.from_json(json, "map<string,struct<latitude:double,longitude:double,confidence:string,method:string>>")).alias("k", "g"))
    return g.select(text.norm_key(F.col("k")).alias("station_key"), "g.*").where("latitude IS NOT NULL AND longitude IS NOT NULL")


def station_list(rows: DataFrame, box: tuple[float, float, float, float], json: str = "value") -> DataFrame:
    """(station_no, station_name, latitude, longitude) of a JSON array of arrays, inside a box (south, north, west, east); a heading row doesn't parse and goes."""
    r = rows.select(F.explode(F.from_json(json, "array<array<string>>")).alias("r")).where(F.size("r") >= 4)
    r = r.select(F.col("r")[0].alias("station_no"), F.col("r")[1].alias("station_name"), text.to_double(F.col("r")[2]).alias("latitude"), text.to_double(F.col("r")[3]).alias("longitude"))
    return r.where(F.col("latitude").between(*box[:2]) & F.col("longitude").between(*box[2:]))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files (also gzipped): an envelope with data, a FeatureCollection or a bare list."""
    feature = f"struct<properties:{properties},geometry:string>"
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    bare = F.from_json("value", f"array<{feature}>")
    inner = F.from_json("value", f"features array<{feature}>, data struct<features:array<{feature}>>")
    features = F.when(F.startswith(F.ltrim("value"), F.lit("[")), bare).otherwise(F.coalesce(inner["data"]["features"], inner["features"]))
    return raw.select(F.explode(features).alias("f")).select("f.properties", "f.geometry")


INCIDENT = "struct<id:string,feedType:string,category1:string,category2:string,cap:struct<event:string>,status:string,size:string,sizeFmt:string,location:string,action:string,webHeadline:string,created:string,updated:string>"


def incidents(features: DataFrame) -> DataFrame:
    """Rows of fire incidents and warnings; geometry is kept where it isn't a mere point."""
    p = lambda name: F.col(f"properties.{name}")
    warning = F.lower(p("feedType")) == "warning"
    centre = geo.geojson_centroid(F.col("geometry"))
    point = F.get_json_object("geometry", "$.type") == "Point"
    return features.select(
        p("id").alias("source_id"), p("feedType").alias("feed_type"), p("category1").alias("category1"), p("category2").alias("category2"), F.when(warning, p("category1")).alias("warning_level"), p("cap.event").alias("event"), p("status").alias("status"),
        F.coalesce(p("sizeFmt"), p("size")).alias("size"), p("location").alias("location"), p("action").alias("action"), F.coalesce(text.blank_to_null(p("webHeadline")), text.blank_to_null(p("location")), p("category1")).alias("headline"),
        times.iso_to_local(p("created")).alias("created"), times.iso_to_local(p("updated")).alias("updated"), centre["latitude"].alias("latitude"), centre["longitude"].alias("longitude"), F.when(~point, F.col("geometry")).alias("geometry"), classify.is_resolved(p("status")).cast("int").alias("resolved"),
    ).where("source_id IS NOT NULL")


ROAD = "struct<id:string,status:string,eventType:string,eventSubType:string,roadAccessType:string,closedRoadName:string,declaredRoadName:string,created:string,lastUpdated:string,description:string,impact:struct<direction:string,impactType:string>>"


def disruptions(features: DataFrame) -> DataFrame:
    """Rows of road disruptions."""
    p = lambda name: F.col(f"properties.{name}")
    centre = geo.geojson_centroid(F.col("geometry"))
    closure = classify.is_closure(p("status"), p("roadAccessType"), p("closedRoadName"), p("eventType"), p("eventSubType"))
    return features.select(
        p("id").alias("source_id"), p("status").alias("status"), F.concat_ws(", ", text.blank_to_null(p("eventType")), text.blank_to_null(p("eventSubType"))).alias("disruption_type"), closure.cast("int").alias("is_closure"), F.coalesce(text.blank_to_null(p("closedRoadName")), text.blank_to_null(p("declaredRoadName"))).alias("road_name"),
        p("impact.direction").alias("direction"), p("description").alias("description"), times.iso_to_local(p("created")).alias("created"), times.iso_to_local(p("lastUpdated")).alias("updated"), centre["latitude"].alias("latitude"), centre["longitude"].alias("longitude"), F.col("geometry"),
    ).where("source_id IS NOT NULL")


def outage_rows(rows: DataFrame) -> DataFrame:
    """(location, customers_off, type): one row for each location of a cell that lists several."""
    place = F.trim(F.replace(F.col("place"), F.lit("\u00a0"), F.lit(" ")))
    return rows.withColumn("place", F.explode(F.split("location", ","))).select(place.alias("location"), text.to_int(F.col("customers")).alias("customers_off"), "type").where("location <> ''")


def read_csv(spark: SparkSession, path: str, names: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """A CSV with renamed columns, those of `columns` only and typed so; absent ones are null, cells that don't parse, too."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    raw = raw.withColumnsRenamed(names)
    return raw.select(*[(F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def power_series(rows: DataFrame) -> DataFrame:
    """UTC stamps and counts as local rows."""
    return rows.select(times.utc_to_local(times.parse(F.col("timestamp"), "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"), *[text.to_int(F.col(c)).alias(c) for c in ("customers_off", "planned", "unplanned")])


def place_map(rows: DataFrame, json: str = "value") -> DataFrame:
    """(location, latitude, longitude) of a JSON map from names to pairs."""
    pairs = rows.select(F.explode(F.from_json(json, "map<string,array<double>>")).alias("location", "p")).where(F.size("p") == 2)
    return pairs.select("location", F.col("p")[0].alias("latitude"), F.col("p")[1].alias("longitude"))


def guide_impacts(rows: DataFrame, json: str = "value") -> DataFrame:
    """(station_key, town, source_pdf, height_m, impact) of guides with nested impacts."""
    guides = F.from_json(json, "guides array<struct<station:string,town:string,source:string,impacts:array<struct<height_m:double,impact:string>>>>")["guides"]
    g = rows.select(F.explode(guides).alias("g")).select("g.*", F.explode("g.impacts").alias("i"))
    return g.select(text.norm_key(F.col("station")).alias("station_key"), "town", F.col("source").alias("source_pdf"), "i.height_m", "i.impact")


def impact_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    """(height_m, impact) of lines of text that begin with a height in metres."""
    pattern = "^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*m?\\s+[-–]?\\s*(\\S.*)$"
    return rows.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).try_cast("double").alias("height_m"), F.trim(F.regexp_extract(line, pattern, 2)).alias("impact"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of image files, to be decoded in tasks."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
