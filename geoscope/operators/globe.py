"""Neighbourhoods on the sphere: zones and nearest searches by great-circle distance, over ±180° and the poles.

Distances and radii are degrees of a great circle (times ``KM_PER_DEGREE``: km). Longitudes count modulo 360, so
179.9 and -179.9 are neighbours, and 354.5 is -5.5; what has no coordinate, or a latitude beyond ±90, is nowhere.

A zone is laid on bands of latitude. How far it reaches to the east and west differs from band to band and may
go once round, and a band's cells are the wider the nearer it is to a pole, so that cells are about as wide as
high and a zone at a pole touches as few as one at the equator. From there on it is the equi-join by cell of
:mod:`geoscope.operators.zones`: broadcast behind a count, or dealt over salts where cells are crowded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscope.operators import nearest
from geoscope.operators.zones import DEFAULT_CELL, FEW_ZONES, SLACK, coordinate_counts, in_boxes, met, spread, with_radius

KM_PER_DEGREE = 6371.0088 * math.pi / 180

#: From these latitudes on a cell is 2, 4, 8 ... times as wide in degrees, as meridians are that much closer.
WIDER_FROM = [math.degrees(math.acos(2.0**-n)) for n in range(1, 10)]
#: Bands of this height for the table of touched cells, which has at most 46 x 91 rows.
COARSE = 4.0
#: Slack of sums of products of sines, and of squared half chords.
ROUNDING, CHORD_SLACK = 1e-14, 1e-12


def wrapped(lon: Column) -> Column:
    """The same meridian from -180 up to 180."""
    return F.when((lon >= -180) & (lon < 180), lon).otherwise(F.pmod(lon + 180, F.lit(360.0)) - 180)


def _half_chord(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """The square of half the chord between two places: grows with their distance."""
    dy, dx = F.sin(F.radians(to_lat - lat) / 2), F.sin(F.radians(to_lon - lon) / 2)
    return dy * dy + F.cos(F.radians(lat)) * F.cos(F.radians(to_lat)) * dx * dx


def arc(lat: Column, lon: Column, to_lat: Column, to_lon: Column) -> Column:
    """Great-circle distance in degrees."""
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), _half_chord(lat, lon, to_lat, to_lon)))))


def _on_globe(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    return rows.filter(F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(lon))


def _width(size: float) -> Column:
    """Width of the cells of the band ``cy``."""
    nearest_edge = F.greatest(F.col("cy") * size, -(F.col("cy") + 1) * size)
    return sum((F.when(nearest_edge >= at, size * 2.0**n).otherwise(0.0) for n, at in enumerate(WIDER_FROM)), F.lit(size))


def touched_cells(zones: DataFrame, size: float) -> DataFrame:
    """One row per zone (``lat, lon, radius``) and cell ``cy, cx`` that it touches, for a size that is a power of two."""
    usable = _on_globe(zones, "lat", "lon").filter("radius >= 0")
    ends = [F.floor((F.col("lat") + sign * (F.col("radius") + SLACK)) / size) for sign in (-1, 1)]
    low = F.greatest(ends[0], F.lit(math.floor(-90 / size)))
    high = F.least(ends[1], F.lit(math.floor(90 / size)))
    bands = spread(usable, "location_id" if "location_id" in zones.columns else "lat").withColumn("cy", F.explode(F.sequence(low, high)))

    def clamped(value: Column, least: Column | float, most: Column | float) -> Column:
        return F.greatest(F.least(value, F.lit(most)), F.lit(least))

    # The latitude at which the zone is widest, and the one next to it inside the band.
    lat, radius = F.radians("lat"), F.radians("radius")
    widest = F.degrees(F.asin(clamped(F.sin(lat) / F.cos(radius), -1.0, 1.0)))
    at = F.radians(clamped(clamped(widest, F.col("cy") * size, (F.col("cy") + 1) * size), -90.0, 90.0))
    ratio = (F.cos(radius) - F.sin(at) * F.sin(lat) - ROUNDING) / F.greatest(F.cos(at) * F.cos(lat), F.lit(1e-12))
    reach = F.when(F.col("radius") >= 90, 180.0).otherwise(F.degrees(F.acos(clamped(ratio, -1.0, 1.0)))) + SLACK
    west, east = wrapped(F.col("lon")) - F.col("_reach"), wrapped(F.col("lon")) + F.col("_reach")

    def cells(start: Column, end: Column) -> Column:
        return F.sequence(F.floor(start / F.col("_width")), F.floor(end / F.col("_width")))

    none = F.array().cast("array<bigint>")
    here = cells(F.greatest(west, F.lit(-180.0)), F.least(east, F.lit(180.0)))
    over_west = F.when(west < -180, cells(west + 360, F.lit(180.0))).otherwise(none)
    over_east = F.when(east > 180, cells(F.lit(-180.0), east - 360)).otherwise(none)
    listed = F.array_distinct(F.concat(here, over_west, over_east))
    found = bands.withColumns({"_reach": reach, "_width": _width(size)}).withColumn("cx", F.explode(listed))
    return found.select(*zones.columns, "cy", "cx")


def with_cell(points: DataFrame, size: float) -> DataFrame:
    """Rows on the globe with their cell."""
    banded = _on_globe(points, "reclat", "reclong").withColumn("cy", F.floor(F.col("reclat") / size))
    return banded.withColumn("cx", F.floor(wrapped(F.col("reclong")) / _width(size)))


def _zone_boxes(lat: float, lon: float, radius: float) -> list[tuple[float, float, float, float]]:
    """Boxes (south, north, west, east) around a zone, one more for each side of ±180° that it reaches over,
    and for longitudes that are written beyond ±180."""
    south, north, lon = lat - radius - SLACK, lat + radius + SLACK, (lon + 180) % 360 - 180
    spans = [(-1e18, -180.0), (180.0, 1e18)]
    if abs(lat) + radius >= 90 - 1e-6:
        spans.append((-180.0, 180.0))
    else:
        reach = math.degrees(math.asin(math.sin(math.radians(radius)) / math.cos(math.radians(lat)))) + 1e-6
        spans += [(w, e) for w, e in ((lon - reach + turn, lon + reach + turn) for turn in (-360, 0, 360)) if e >= -180 and w <= 180]
    return [(south, north, west, east) for west, east in spans]


def near(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """Observations that may lie in one of the zones: all that do and some more. As :func:`zones.near`, boxes that
    files answer from their statistics for up to ``FEW_ZONES`` zones, a small table of touched cells for more."""
    rows = _on_globe(zones.select("lat", "lon", "radius"), "lat", "lon").filter("radius >= 0")
    few = rows.limit(FEW_ZONES + 1).collect()
    if not few:
        return obs.filter(F.lit(False))
    if len(few) <= FEW_ZONES:
        return in_boxes(obs, [box for r in few for box in _zone_boxes(r.lat, r.lon, r.radius)])
    cells = touched_cells(rows, COARSE).select("cy", "cx").distinct()
    return with_cell(obs, COARSE).join(F.broadcast(cells), ["cy", "cx"], "left_semi").select(*obs.columns)


def _pairs(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    pairs = met(with_cell(near(points, zones), cell), touched_cells(zones, cell), cell)
    distance = arc(F.col("lat"), F.col("lon"), F.col("reclat"), F.col("reclong"))
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= F.col("radius"))


def within_radius(obs: DataFrame, locations: DataFrame, radius: float | None = None, cell: float = DEFAULT_CELL) -> DataFrame:
    """Every observation within ``radius`` degrees of arc of each location (default: its ``radius`` column): the
    ``location_id``, all columns of the observation and ``distance`` in degrees of arc."""
    zones = with_radius(locations, radius).select("location_id", "lat", "lon", "radius")
    return _pairs(obs, zones, cell).select("location_id", *obs.columns, "distance")


def zone_counts(obs: DataFrame, locations: DataFrame, radius: float | None = None, cell: float = DEFAULT_CELL) -> DataFrame:
    """(location_id, n): records within each zone, for zones with any. Records collapse to coordinates first."""
    zones = with_radius(locations, radius).select("location_id", "lat", "lon", "radius")
    return _pairs(coordinate_counts(obs), zones, cell).groupBy("location_id").agg(F.sum("n").alias("n"))


def _bounds(south: Column, north: Column, west: Column, east: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """As :func:`nearest._bounds`, for a query point, in squared half chords. Along a meridian the cosine of the
    distance is a sine wave of the latitude, so its peak, or else the nearer end, is the nearest place of a box's side."""
    q_lat, q_lon = F.col("q_south"), F.col("q_west")
    sides = [F.least(F.abs(side - q_lon), 360 - F.abs(side - q_lon)) for side in (west, east)]
    gap = F.radians(F.when(q_lon.between(west, east), 0.0).otherwise(F.least(*sides)))
    up, along = F.sin(F.radians(q_lat)), F.cos(F.radians(q_lat)) * F.cos(gap)
    ends = [up * F.sin(F.radians(at)) + along * F.cos(F.radians(at)) for at in (south, north)]
    peak = F.degrees(F.atan2(up, along)).between(south, north)
    cosine = F.when(peak, F.sqrt(up * up + along * along)).otherwise(F.greatest(*ends))
    return (1 - cosine) / 2 - CHORD_SLACK, _half_chord(q_lat, q_lon, lat, lon)


def nearest_distance(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Degrees of arc from each location to its nearest observation: (location_id, d_min). Locations that are not
    on the globe have none; with no observation the result is empty."""
    coordinates = _on_globe(obs, "reclat", "reclong").select("reclat", wrapped(F.col("reclong")).alias("reclong")).distinct()
    here = _on_globe(locations.select("location_id", "lat", "lon"), "lat", "lon").withColumn("lon", wrapped(F.col("lon")))
    points = here.selectExpr("location_id AS qid", "lat AS q_south", "lat AS q_north", "lon AS q_west", "lon AS q_east")
    pairs = nearest.nearest_pairs(coordinates, points, bounds=_bounds).withColumnRenamed("qid", "location_id").join(here, "location_id")
    distance = arc(F.col("lat"), F.col("lon"), F.col("reclat"), F.col("reclong"))
    return pairs.groupBy("location_id").agg(F.min(distance).alias("d_min"))
