"""Distances, grids, geohashes and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0
#: The geohash alphabet.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Km to a pixel of a radar image by the last digit of its id (range 512, 256, 128, 64 km on 512 pixels).
KM_PER_PX = {"1": 2.0, "2": 1.0, "3": 0.5, "4": 0.25}
#: Km to a degree of latitude, and of longitude at the equator, for radar images.
KM_LAT, KM_LON = 110.574, 111.320


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(vx: Column, vy: Column) -> Column:
    """Compass bearing of a velocity in image coordinates (y grows southwards)."""
    return F.pmod(F.degrees(F.atan2(vx, -vy)), F.lit(360.0))


def km_per_px(radar_id: Column) -> Column:
    pairs = [F.lit(x) for pair in KM_PER_PX.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.right(radar_id, F.lit(1))), F.lit(0.5))


def pixel_to_latlon(x: Column, y: Column, site_lat: Column, site_lon: Column, scale: Column, size: int = 512) -> Column:
    """struct(latitude, longitude), to five places, of a pixel of an image centred on the site."""
    lat = site_lat - (y - size / 2) * scale / KM_LAT
    lon = site_lon + (x - size / 2) * scale / (KM_LON * F.cos(F.radians(site_lat)))
    return F.struct(F.round(lat, 5).alias("latitude"), F.round(lon, 5).alias("longitude"))


def geohash_centre(code: Column) -> Column:
    """struct(latitude, longitude) of a geohash cell's centre: its bits, taken in turn for longitude and latitude."""
    letters = F.filter(F.split(F.lower(code), ""), lambda x: x != "")
    value = lambda x: F.instr(F.lit(GEOHASH), x) - 1
    bits = F.flatten(F.transform(letters, lambda x: F.array(*[F.shiftright(value(x), 4 - k).bitwiseAND(F.lit(1)) for k in range(5)])))
    start = F.struct(F.lit(0.0).alias("value"), F.lit(1.0).alias("step"))

    def centre(parity: int, half: float) -> Column:
        own = F.filter(bits, lambda _, k: k % 2 == parity)
        made = F.aggregate(own, start, lambda s, b: F.struct((s["value"] + (2 * b - 1) * s["step"] / 2).alias("value"), (s["step"] / 2).alias("step")))
        return made["value"] * half

    good = code.rlike(f"(?i)^[{GEOHASH}]+$")
    return F.when(good, F.struct(centre(1, 90.0).alias("latitude"), centre(0, 180.0).alias("longitude")))


def geojson_points(geometry: Column) -> Column:
    """All [longitude, latitude] pairs in a GeoJSON text, of any geometry, as an array of structs."""
    number = "-?[0-9]+(?:\\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
    pairs = F.regexp_extract_all(geometry, F.lit(f"\\[\\s*({number}\\s*,\\s*{number})"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].try_cast("double").alias("longitude"), F.trim(F.split(p, ",")[1]).try_cast("double").alias("latitude")))


def geojson_centroid(geometry: Column) -> Column:
    """struct(latitude, longitude): the mean of all vertices; null without any."""
    points = geojson_points(geometry)
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[name]) / F.size(points)
    return F.when(F.size(points) > 0, F.struct(mean("latitude").alias("latitude"), mean("longitude").alias("longitude")))


def geojson_polygons(geometry: Column) -> Column:
    """The polygons (arrays of rings) of a Polygon, MultiPolygon or GeometryCollection."""
    ring = "array<array<array<double>>>"
    one = F.from_json(F.get_json_object(geometry, "$.coordinates"), ring)
    many = F.from_json(F.get_json_object(geometry, "$.coordinates"), f"array<{ring}>")
    parts = F.from_json(F.get_json_object(geometry, "$.geometries"), "array<struct<type:string,coordinates:string>>")
    polygons = F.transform(F.filter(parts, lambda g: g["type"] == "Polygon"), lambda g: F.from_json(g["coordinates"], ring))
    multis = F.flatten(F.transform(F.filter(parts, lambda g: g["type"] == "MultiPolygon"), lambda g: F.from_json(g["coordinates"], f"array<{ring}>")))
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).when(kind == "GeometryCollection", F.concat(polygons, multis))


def geojson_lines(geometry: Column) -> Column:
    """The lines (arrays of points) of a LineString or MultiLineString."""
    one = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<double>>")
    many = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    kind = F.get_json_object(geometry, "$.type")
    return F.when(kind == "LineString", F.array(one)).when(kind == "MultiLineString", many)


def feature(geometry: Column, properties: Column) -> Column:
    """A GeoJSON Feature as text; null if the geometry isn't JSON."""
    valid = F.try_parse_json(geometry).isNotNull()
    return F.when(valid, F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(properties), F.lit("}")))
