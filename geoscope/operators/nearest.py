"""Nearest neighbour joins without a search radius.

Places are summarised in a pyramid of grid cells (each a power of two in size, so parents nest
exactly). A query walks down from the coarsest level: of each cell it knows the box that holds
the cell's places and one real place. The nearest box edge is a lower bound, the real place an
upper bound; cells whose lower bound exceeds the best upper bound are dropped. A query keeps a
handful of cells per level however dense or empty its surroundings are. A cell of the last level that
holds more than ``LEAF`` places is split on, by levels that only such cells have, so a query meets
a bounded number of places however crowded its surroundings are. All comparisons use the same floating expression as
the final distance, so no true nearest place, ties included, is ever dropped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.operators.zones import coordinate_counts, grid_cell, located, planar_distance, spread

# Each level has up to 64 children per cell of the one before.
LEVELS = (64.0, 8.0, 1.0, 0.125, 0.015625)

# Cells of the finest level with more coordinates than this are split further, by these levels.
LEAF = 64
DEEP = (2.0**-10, 2.0**-14, 2.0**-18)

# Down to this size a level has at most 181 x 361 cells, which is a small table to broadcast.
BROADCAST_SIZE = 1.0


def globe_cell(lat: str, lon: str, size: float) -> tuple[Column, Column]:
    """Cell of a coordinate. Coordinates off the globe count to the outermost cells, so the number
    of cells is bounded whatever the data; cell extents are measured, so results do not change."""

    def within(name: str, limit: float) -> Column:
        low, high = math.floor(-limit / size), math.floor(limit / size)
        return F.greatest(F.least(grid_cell(name, size), F.lit(high)), F.lit(low))

    return within(lat, 90.0), within(lon, 180.0)


def _norm(dy: Column, dx: Column) -> Column:
    return F.sqrt(dy * dy + dx * dx)


def _bounds(south: Column, north: Column, west: Column, east: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Between the query box and an extent that holds the real place (lat, lon): no place of the extent
    is nearer to any point of the box than the first; none of these points is further from the real
    place than the second."""
    q_south, q_north, q_west, q_east = [F.col(c) for c in ("q_south", "q_north", "q_west", "q_east")]
    low = _norm(
        F.greatest(south - q_north, q_south - north, F.lit(0.0)), F.greatest(west - q_east, q_west - east, F.lit(0.0))
    )
    high = _norm(
        F.greatest(F.abs(lat - q_south), F.abs(lat - q_north)), F.greatest(F.abs(lon - q_west), F.abs(lon - q_east))
    )
    return low, high


def _pyramid(points: DataFrame, levels: Sequence[float], under: float | None = None) -> list[DataFrame]:
    """Occupied cells per level, coarsest first: own and parent cell (of size ``under`` for the first level, if
    given), extent, one real place; for the finest level, the number of places.

    Built from the finest level upwards, so the points are read once.
    """
    cy, cx = globe_cell("reclat", "reclong", levels[-1])
    level = points.groupBy(cy.alias("cy"), cx.alias("cx")).agg(
        F.min("reclat").alias("south"),
        F.max("reclat").alias("north"),
        F.min("reclong").alias("west"),
        F.max("reclong").alias("east"),
        F.min(F.struct("reclat", "reclong")).alias("real"),
        F.count(F.lit(1)).alias("places"),
    )
    out = []
    for size, above in zip(reversed(levels), [*reversed(levels[:-1]), under]):
        if above:
            level = level.withColumns({"py": grid_cell("cy", above / size), "px": grid_cell("cx", above / size)})
        out.append(F.broadcast(level) if size >= BROADCAST_SIZE else level)
        if above and above != under:
            level = level.groupBy(F.col("py").alias("cy"), F.col("px").alias("cx")).agg(
                F.min("south").alias("south"),
                F.max("north").alias("north"),
                F.min("west").alias("west"),
                F.max("east").alias("east"),
                F.min("real").alias("real"),
            )
    return out[::-1]


Bounds = Callable[[Column, Column, Column, Column, Column, Column], tuple[Column, Column]]

_BOX = ["deal", "qid", "q_south", "q_north", "q_west", "q_east"]


def _kept(seen: DataFrame, bounds: Bounds = _bounds) -> DataFrame:
    """Of (query box, cell) rows, those whose cell can hold the nearest place of some point in the box."""
    extent = [F.col(c) for c in ("south", "north", "west", "east")]
    low, high = bounds(*extent, F.col("real.reclat"), F.col("real.reclong"))
    number = ["places"] if "places" in seen.columns else []
    return (
        seen.withColumn("low", low)
        .withColumn("best", F.min(high).over(Window.partitionBy("deal", "qid")))
        .filter(F.col("low") <= F.col("best"))
        .select(*_BOX, F.col("cy").alias("py"), F.col("cx").alias("px"), *number)
    )


def candidate_cells(points: DataFrame, queries: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """For each query box (qid, q_south, q_north, q_west, q_east): the finest cells (cy, cx) that can
    hold the nearest place of some point in the box, with their number of ``places``. A point query is a box
    without extent."""
    return _descended(points, queries, levels).select("qid", F.col("py").alias("cy"), F.col("px").alias("cx"), "places")


def _descended(points: DataFrame, queries: DataFrame, levels: Sequence[float], bounds: Bounds = _bounds) -> DataFrame:
    # Dealt out once by a hash of the query; as long as the levels are small enough to be broadcast,
    # no join or window below moves a row again.
    kept = spread(queries.withColumn("deal", F.xxhash64("qid")).select(*_BOX), "deal")
    for i, level in enumerate(_pyramid(points, levels)):
        if i == 0:
            # At most 4 x 6 rows, listed for every query.
            top = level.agg(F.collect_list(F.struct("cy", "cx", "south", "north", "west", "east", "real"))).scalar()
            seen = kept.withColumn("top", F.explode(top)).select(*_BOX, "top.*")
        else:
            seen = kept.drop("places").join(level, ["py", "px"])
        kept = _kept(seen, bounds)
    return kept


def nearest_pairs(
    coordinates: DataFrame,
    queries: DataFrame,
    levels: Sequence[float] = LEVELS,
    deep: Sequence[float] = DEEP,
    leaf: int = LEAF,
    bounds: Bounds = _bounds,
) -> DataFrame:
    """(qid, reclat, reclong): the coordinates each query box may have nearest, some ``leaf`` for each cell kept.
    ``bounds`` measures from the query box to a cell's extent and to one place in it."""
    kept = _descended(coordinates, queries, levels, bounds)
    single = coordinates.withColumns(dict(zip(("py", "px"), globe_cell("reclat", "reclong", levels[-1]))))
    pairs = kept.filter(F.col("places") <= leaf).select("qid", "py", "px").join(single, ["py", "px"])
    # What follows is empty unless a cell is crowded, and adaptive execution then leaves it out.
    crowded = kept.filter(F.col("places") > leaf)
    places = single.join(crowded.select("py", "px").distinct(), ["py", "px"], "left_semi").select("reclat", "reclong")
    inner = crowded.drop("places")
    for level in _pyramid(places, deep, under=levels[-1]):
        inner = _kept(inner.drop("places").join(level, ["py", "px"]), bounds)
    finest = places.withColumns(dict(zip(("py", "px"), globe_cell("reclat", "reclong", deep[-1]))))
    return pairs.unionByName(inner.select("qid", "py", "px").join(finest, ["py", "px"])).select("qid", "reclat", "reclong")


def nearest_distance(obs: DataFrame, locations: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Distance from each location to its nearest observation: (location_id, d_min).

    Observations collapse to distinct coordinates first. With an empty catalogue no location
    has a nearest observation and the result is empty.
    """
    coordinates = located(obs).select("reclat", "reclong").distinct()
    points = locations.select(
        F.col("location_id").alias("qid"),
        F.col("lat").alias("q_south"),
        F.col("lat").alias("q_north"),
        F.col("lon").alias("q_west"),
        F.col("lon").alias("q_east"),
    )
    here = locations.select("location_id", "lat", "lon")
    return (
        nearest_pairs(coordinates, points, levels)
        .withColumnRenamed("qid", "location_id")
        .join(here, "location_id")
        .groupBy("location_id")
        .agg(F.min(planar_distance(F.col("lat"), F.col("lon"))).alias("d_min"))
    )


def _boxes(coordinates: DataFrame, size: float) -> DataFrame:
    """Occupied cells of observed coordinates with their extent, as query boxes."""
    return coordinates.groupBy(_box_id(size).alias("qid")).agg(
        F.min("reclat").alias("q_south"),
        F.max("reclat").alias("q_north"),
        F.min("reclong").alias("q_west"),
        F.max("reclong").alias("q_east"),
    )


def _box_id(size: float) -> Column:
    y, x = globe_cell("reclat", "reclong", size)
    return F.struct(y.alias("y"), x.alias("x"))


def _possible(pairs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Of (box, place) pairs, those in which the place can be the nearest of some point in the box. ``within``
    names columns that a box has one value of and by which the pairs are dealt already, so that they stay."""
    low, high = _bounds(F.col("lat"), F.col("lat"), F.col("lon"), F.col("lon"), F.col("lat"), F.col("lon"))
    return (
        pairs.withColumn("low", low)
        .withColumn("best", F.min(high).over(Window.partitionBy(*within, "qid")))
        .filter(F.col("low") <= F.col("best"))
        .select(*within, "qid", "place_id", "country", "lat", "lon")
    )


# Observed coordinates are grouped into boxes of the first size (at most one per square degree of
# the globe) for the descent, then into boxes of halved sizes, the last for the final choice of places.
BOX_SIZES = (1.0, 0.5, 0.25, 0.125)

# Boxes are many, so their descent takes smaller steps: fewer children are looked at per cell kept.
PLACE_LEVELS = (64.0, 16.0, 4.0, 1.0)


def nearest_place(obs: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The nearest place of every distinct observed coordinate; ties go to the lower place_id.

    One row per coordinate: reclat, reclong, n (records there), place_id, country, distance.
    The descent runs once per square degree that holds observations, not per coordinate. Its
    places are narrowed to those of each half, quarter and eighth of a degree; a box meets
    the places of the one around it where these lie, so only the places kept are shuffled. A coordinate meets
    those of the last.
    """
    levels = PLACE_LEVELS
    coordinates = coordinate_counts(obs)
    places = gazetteer.select("place_id", "country", "lat", "lon").dropna(subset=["lat", "lon"])
    cy, cx = globe_cell("lat", "lon", levels[-1])
    known = places.withColumns({"cy": cy, "cx": cx})

    wide = _boxes(coordinates, BOX_SIZES[0])
    points = places.select(F.col("lat").alias("reclat"), F.col("lon").alias("reclong"))
    near = _possible(candidate_cells(points, wide, levels).join(known, ["cy", "cx"]).join(wide, "qid"))

    for above, now in zip(BOX_SIZES, BOX_SIZES[1:]):
        parent = F.struct(grid_cell("qid.y", above / now).alias("y"), grid_cell("qid.x", above / now).alias("x"))
        boxes = _boxes(coordinates, now).withColumn("parent", parent)
        near = _possible(boxes.join(near.withColumnRenamed("qid", "parent"), "parent"), ["parent"]).drop("parent")

    distance = planar_distance(F.col("lat"), F.col("lon"))
    best = F.min(F.struct(distance.alias("distance"), F.col("place_id"), F.col("country")))
    return (
        coordinates.withColumn("qid", _box_id(BOX_SIZES[-1]))
        .join(near, "qid")
        .groupBy("reclat", "reclong", "n")
        .agg(best.alias("best"))
        .select("reclat", "reclong", "n", "best.place_id", "best.country", "best.distance")
    )


def country_counts(obs: DataFrame, gazetteer: DataFrame, country_names: DataFrame) -> DataFrame:
    """Observations per country of their nearest place, with log10(count + 1), name and ISO3.

    Records on the (0, 0) coordinate are not counted. Countries without a name entry keep null.
    """
    places = nearest_place(obs.filter(~((F.col("reclat") == 0) & (F.col("reclong") == 0))), gazetteer)
    counts = places.groupBy("country").agg(F.sum("n").alias("n"))
    return country_lookup(counts, country_names).withColumn("log_n", F.log10(F.col("n") + 1))


def country_lookup(rows: DataFrame, country_names: DataFrame) -> DataFrame:
    """Add country_name and iso_alpha by country code; unknown codes keep null."""
    return rows.join(country_names, "country", "left")
