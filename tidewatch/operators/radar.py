"""Storm cells in radar frames: where they are, how strong, where they go and what they will reach."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import KM_LAT, KM_LON
from tidewatch.functions.runs import runs
from tidewatch.operators.spatial import Tracker
from tidewatch.sources import png

#: Colours (red, green, blue) of the echo levels 1 to 15.
PALETTE = [
    (245, 245, 255),
    (180, 180, 255),
    (120, 120, 255),
    (20, 20, 255),
    (0, 216, 195),
    (0, 150, 144),
    (0, 102, 102),
    (255, 255, 0),
    (255, 200, 0),
    (255, 150, 0),
    (255, 100, 0),
    (255, 0, 0),
    (200, 0, 0),
    (120, 0, 0),
    (40, 0, 0),
]
#: How far a colour may be off, the level from which echoes count, the pixels of the smallest cell, the gaps
#: that cells are closed over when they form and before they part, and the minutes and least speed of a projection.
TOLERANCE, DETECT, LEAST, GAP, PART_GAP, MINUTES, LEAST_KMH = 30, 3, 90, 6, 14, 30, 5.0

CELLS = "radar_id string, ts timestamp_ntz, cell_id string, x double, y double, latitude double, longitude double, area_km2 double, max_level int, mean_level double, intensity_score double, classification string, speed_kmh double, bearing_deg double, status string, impact_geojson string"


def _grown(mask: np.ndarray, half: list[int]) -> np.ndarray:
    """Pixels that a shape, centred on them, has part of the mask in; half: its half widths from top to bottom."""
    sums = np.pad(np.cumsum(mask, axis=1), ((0, 0), (1, 0)))
    at, (height, width) = np.arange(mask.shape[1]), mask.shape
    out = np.zeros_like(mask)
    for dy, w in enumerate(half, -(len(half) // 2)):
        near = sums[:, np.minimum(at + w + 1, width)] > sums[:, np.maximum(at - w, 0)]
        if abs(dy) < height:
            out[max(0, dy) : height + min(0, dy)] |= near[max(0, -dy) : height - max(0, dy)]
    return out


def _shrunk(mask: np.ndarray, half: list[int]) -> np.ndarray:
    return ~_grown(~mask, half)


def _disc(r: int) -> list[int]:
    return [round(math.sqrt(r * r - dy * dy)) for dy in range(-r, r + 1)]


def _closed(mask: np.ndarray, gap: int) -> np.ndarray:
    return _shrunk(_grown(mask, _disc(gap)), _disc(gap))


def label(mask: np.ndarray, *, corners: bool = True) -> tuple[np.ndarray, int]:
    """(numbers from 1, how many) of a mask's connected parts; pixels that touch at corners only are connected if corners."""
    edges = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    slack = 1 if corners else 0
    a, b = starts.tolist(), ends.tolist()
    for y in range(1, mask.shape[0]):
        i, k = first[y - 1], first[y]
        while i < first[y] and k < first[y + 1]:
            if a[i] < b[k] + slack and a[k] < b[i] + slack:
                p, q = sorted((root(i), root(k)))
                parent[q] = p
            if b[i] < b[k]:
                i += 1
            else:
                k += 1
    roots = [root(k) for k in range(len(rows))]
    number = {r: n for n, r in enumerate(dict.fromkeys(roots), 1)}
    out = np.zeros(mask.shape, np.int32)
    for y, s, e, r in zip(rows.tolist(), a, b, roots, strict=True):
        out[y, s:e] = number[r]
    return out, len(number)


def _outlines(mask: np.ndarray) -> list[np.ndarray]:
    """The mask's connected parts with their holes filled, and what lies in these."""
    gaps, _ = label(~np.pad(mask, 1), corners=False)
    parts, n = label((gaps != gaps[0, 0])[1:-1, 1:-1])
    return [parts == k for k in range(1, n + 1)]


def _measure(part: np.ndarray, echo: np.ndarray, levels: np.ndarray, km_per_px: float) -> dict | None:
    pixels = int(np.count_nonzero(echo & part))
    if pixels < LEAST:
        return None
    box = tuple(slice(int(v.min()), int(v.max()) + 1) for v in np.nonzero(part))
    inside = levels[:, box[0], box[1]] & part[box]
    counts = inside.reshape(len(levels), -1).sum(axis=1)
    weight = np.max(inside * np.arange(1, len(levels) + 1)[:, None, None], axis=0)
    ys, xs = np.nonzero(weight)
    w = weight[ys, xs].astype(float)
    highest, mean = int(weight.max()), float((counts * np.arange(1, len(levels) + 1)).sum() / counts.sum())
    area = pixels * km_per_px**2
    kind = "strong" if highest >= 12 or (highest >= 10 and mean >= 8) else "moderate" if highest >= 8 else "weak"
    score = 4 * mean + 2.5 * highest + min(area / 15, 20.0)
    return {"x": float((xs * w).sum() / w.sum()) + box[1].start, "y": float((ys * w).sum() / w.sum()) + box[0].start, "pixels": pixels, "area_km2": area, "max_level": highest, "mean_level": mean, "intensity_score": score, "classification": kind, "part": part}


def detect_cells(colours: np.ndarray, alpha: np.ndarray, km_per_px: float = 1.0, before: np.ndarray | None = None) -> list[dict]:
    """The cells of one frame: echoes from level DETECT on, closed over GAP pixels, with LEAST pixels or more.

    `before` numbers the cells of the frame before: a region, closed over PART_GAP, that held exactly one of them stays
    one cell.
    """
    off = np.array(PALETTE, np.int16)[:, None, None, :] - colours.astype(np.int16)
    levels = (np.abs(off) <= TOLERANCE).all(axis=3) & (alpha > 0)
    echo = levels[DETECT - 1 :].any(axis=0)
    if np.count_nonzero(echo) < LEAST:
        return []
    square = [1, 1, 1]
    echo = _grown(_shrunk(echo, square), square)
    fine, chosen = _closed(echo, GAP), []
    for region in _outlines(_closed(echo, PART_GAP)):
        held = np.unique(before[region]) if before is not None else np.empty(0)
        chosen += [region] if np.count_nonzero(held) == 1 else _outlines(fine & region)
    return [d for part in chosen if (d := _measure(part, echo, levels, km_per_px))]


def _hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The convex hull, in order."""
    points = sorted(set(points))
    sides = []
    for way in (points, points[::-1]):
        side: list[tuple[int, int]] = []
        for p in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return sides or points


def impact_polygon(part: np.ndarray, speed: float | None, bearing: float | None, km_per_px: float) -> list[tuple[int, int]]:
    """Pixels around what a cell reaches in MINUTES: the ellipse of its second moments, here and where it will be."""
    ys, xs = np.nonzero(part)
    values, axes = np.linalg.eigh(np.cov(np.stack([xs, ys]), bias=True) if len(xs) > 1 else np.zeros((2, 2)))
    t = np.radians(np.arange(0, 360, 12))
    half = np.maximum(2 * np.sqrt(np.maximum(values, 0)), 3.0)
    ring = (axes @ (half[:, None] * np.stack([np.cos(t), np.sin(t)]))).T + [xs.mean(), ys.mean()]
    rings = [ring]
    if speed is not None and bearing is not None and speed >= LEAST_KMH:
        way = speed / 60 * MINUTES / km_per_px
        rings.append(ring + [math.sin(math.radians(bearing)) * way, -math.cos(math.radians(bearing)) * way])
    return _hull([(int(x), int(y)) for r in rings for x, y in r])


def pixel_place(x: float, y: float, site: tuple[float, float], km_per_px: float, size: int) -> tuple[float, float]:
    """(latitude, longitude), to five places, of a pixel of a frame that is centred on the radar."""
    lat, lon = site
    return round(lat - (y - size / 2) * km_per_px / KM_LAT, 5), round(lon + (x - size / 2) * km_per_px / (KM_LON * math.cos(math.radians(lat))), 5)


def _impact(cell: dict, motion: tuple, radar: str, site: tuple[float, float] | None, km_per_px: float, stamp: str, size: int) -> str | None:
    """A GeoJSON feature of what a moderate or strong cell reaches; None for others, and where the radar's place isn't known."""
    if site is None or cell["classification"] == "weak":
        return None
    name, speed, bearing = motion
    ring = [list(pixel_place(x, y, site, km_per_px, size)[::-1]) for x, y in impact_polygon(cell["part"], speed, bearing, km_per_px)]
    facts = {"cell_id": name, "radar_id": radar, "classification": cell["classification"], "intensity_score": round(cell["intensity_score"], 1), "area_km2": round(cell["area_km2"], 1), "speed_kmh": None if speed is None else round(speed, 1), "bearing_deg": None if bearing is None else round(bearing), "valid_from": stamp, "projection_minutes": MINUTES}
    return json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]}, "properties": facts})


def scale_of(radar: str, size: int = 512) -> float:
    """Kilometres to a pixel, by the last character of a radar's id."""
    return 2 * {"1": 512, "2": 256, "3": 128, "4": 64}.get(radar[-1:], 128) / size


def storm_cells(frames: DataFrame, sites: dict[str, tuple[float, float]] | None = None, *, decode: Callable = png.decode) -> DataFrame:
    """CELLS of frames (radar_id, ts, image): a task walks over a radar's frames in order and holds one at a time.

    `sites` has radars' coordinates by the first five characters of their ids. Frames that can't be read are skipped, as
    are rows without a radar or a time; of rows with one radar and time each is a frame.
    """
    sites = sites or {}
    dealt = frames.where("radar_id IS NOT NULL AND ts IS NOT NULL").select("radar_id", "ts", "image").repartition("radar_id").sortWithinPartitions("radar_id", "ts")
    names = [f.split()[0] for f in CELLS.split(", ")]

    def run(batches):
        import pyarrow as pa

        radar, tracker, before = None, Tracker(), None
        for rows in runs(batches, 2):
            for image in rows.column(2).to_pylist():
                if (now := rows.column(0)[0].as_py()) != radar:
                    radar, tracker, before = now, Tracker(), None
                made = decode(image)
                if made is None:
                    continue
                colours, alpha = made
                at, size = rows.column(1)[0], colours.shape[1]
                scale, site = scale_of(radar, size), sites.get(radar[:5])
                cells = detect_cells(colours, alpha, scale, before if before is not None and before.shape == alpha.shape else None)
                moved = tracker.step(at.cast(pa.int64()).as_py() / 1e6, [(c["x"], c["y"], c["pixels"]) for c in cells], scale)
                before, out = np.zeros(alpha.shape, np.int32), []
                for c, (n, speed, bearing, status) in zip(cells, moved, strict=True):
                    before[c["part"]] = n
                    lat, lon = pixel_place(c["x"], c["y"], site, scale, size) if site else (None, None)
                    name = f"{radar}-{n}"
                    out.append((radar, at.as_py(), name, c["x"], c["y"], lat, lon, *(c[k] for k in ("area_km2", "max_level", "mean_level", "intensity_score", "classification")), speed, bearing, status, _impact(c, (name, speed, bearing), radar, site, scale, str(at.as_py()), size)))
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    import pyarrow as pa

    kinds = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "double": pa.float64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CELLS.split(", "))])
    return dealt.mapInArrow(run, CELLS)


def storm_alerts(cells: DataFrame) -> DataFrame:
    """(cell_id, ts, alert_type, classification): where a cell is moderate or strong for the first time, or graver than ever."""
    grave = F.when(F.col("classification") == "strong", 1).when(F.col("classification") == "moderate", 2)
    rows = cells.withColumn("_grave", grave).where("_grave IS NOT NULL")
    # a cell has at most two alerts: its first frame of either class, the strong one always, the moderate one if it came first
    first = rows.groupBy("cell_id", "_grave").agg(F.min("ts").alias("ts"))
    both = first.groupBy("cell_id").agg(F.min(F.when(F.col("_grave") == 1, F.col("ts"))).alias("strong"), F.min(F.when(F.col("_grave") == 2, F.col("ts"))).alias("moderate"))
    early = F.col("moderate").isNotNull() & (F.col("strong").isNull() | (F.col("moderate") < F.col("strong")))
    alert = lambda ts, kind, name: F.struct(ts.alias("ts"), kind.alias("alert_type"), F.lit(name).alias("classification"))
    new, graver = F.lit("new_cell"), F.when(early, "escalation").otherwise("new_cell")
    alerts = F.array_compact(F.array(F.when(early, alert(F.col("moderate"), new, "moderate")), F.when(F.col("strong").isNotNull(), alert(F.col("strong"), graver, "strong"))))
    return both.select("cell_id", F.explode(alerts).alias("a")).select("cell_id", "a.*")
