"""Joining observations to many zones at once, and summarising what lies in each zone.

A zone is a row with a key, a centre (``lat``, ``lon``) and a ``radius`` in degrees; its shape is
a planar disc (``radius``) or a square (``box``). A distance test alone would plan as a nested
loop over all pairs, so zones are laid on a grid and joined by grid cell:

* rows wanted (``within_zone``): zones list the cells they touch, observations know their own
  cell, an equi-join brings them together and the exact test decides.
* summaries wanted (``zone_summary``): observations first collapse to one row per coordinate, and
  those to one row per cell on every level of a pyramid. A zone is covered from coarse to fine: a
  cell that lies wholly inside adds its ready-made summary, whatever its size, and only what crosses
  the rim is cut further, down to cells that are tested point by point. So a zone's cells grow with
  its circumference, not with its area, and neither a heap of records on one spot nor a crowded cell
  is ever multiplied by the zones that cover it.

Few zones (``near``, ``bounded``) keep the catalogue where it is: what lies outside their boxes is not read
where the store is in space order, and their cells are broadcast behind a count. Beyond that, zone cells carry a
merge hint: Spark estimates an exploded table by its small input and would broadcast it, whatever
it has grown to.

Where a square degree holds very many rows, or few rows meet very many zones, both sides of a join for pairs
are dealt over salts (``dealt``), in proportion to the rows and to the pairs. Summaries see coordinates, not
records, and their rim cells at most one cell's; adaptive skew handling splits such partitions.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscope.functions.space import PLACE, place_runs

DEFAULT_RADIUS = 2.5

# Cells are powers of two, so a coordinate divided by the size is exact.
DEFAULT_CELL = 0.5

# Rounding slack when deciding which cells a zone touches or covers. Touched cells may be too
# many and covered ones too few; the exact test settles the difference.
SLACK = 1e-9

MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


def grid_cell(value: Column | str, size: float) -> Column:
    """Cell number of a coordinate that is not null, for a size that is a power of two.

    Written as a product and marked as never null, because join keys that look nullable make
    Catalyst push differing null tests into otherwise equal branches, which then are not shared.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.floor(v * (1.0 / size)), F.lit(0).cast("long"))


def located(rows: DataFrame) -> DataFrame:
    """Rows that have a coordinate."""
    return rows.filter(F.col("reclat").isNotNull() & F.col("reclong").isNotNull())


def planar_distance(lat: Column, lon: Column) -> Column:
    """Distance in degrees between a row's observation and (lat, lon); no wrap at ±180°."""
    dy, dx = F.col("reclat") - lat, F.col("reclong") - lon
    return F.sqrt(dy * dy + dx * dx)


def in_zone(shape: str) -> Column:
    if shape == "box":
        return F.col("reclat").between(F.col("lat") - F.col("radius"), F.col("lat") + F.col("radius")) & F.col(
            "reclong"
        ).between(F.col("lon") - F.col("radius"), F.col("lon") + F.col("radius"))
    if shape != "radius":
        raise ValueError(f"unknown zone shape {shape}")
    return planar_distance(F.col("lat"), F.col("lon")) <= F.col("radius")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal out rows that are few but stand for much work over as many tasks as a shuffle has.

    A given number of partitions keeps AQE, which only sees bytes, from merging them again, and
    later aggregations by the same keys find their rows already in place.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys)


def touched_cells(zones: DataFrame, size: float, shape: str) -> DataFrame:
    """One row per zone and grid cell of this size that it touches."""

    def touched(centre: str) -> Column:
        low, high = (f"coalesce(floor(({centre} {sign} (radius + {SLACK}D)) * {1.0 / size}D), 0L)" for sign in "-+")
        return F.expr(f"explode(sequence({low}, {high}))")

    # Dropping nulls here, where every branch begins, keeps Catalyst from adding the same test to some.
    usable = zones.dropna(subset=["location_id", "lat", "lon", "radius"])
    cells = spread(usable, "location_id").withColumn("cy", touched("lat")).withColumn("cx", touched("lon"))
    return cells.filter(_gap(size, shape, "near") <= F.col("radius") + SLACK) if shape == "radius" else cells


def _gap(size: float, shape: str, which: str) -> Column:
    """Distance from a zone's centre to the nearest or farthest point of the cell (cy, cx)."""
    parts = []
    for centre, at in (("lat", "cy"), ("lon", "cx")):
        low, high = f"({at} * {size}D - {centre})", f"({centre} - ({at} + 1) * {size}D)"
        parts.append(f"greatest({low}, {high}, 0D)" if which == "near" else f"greatest(abs({low}), abs({high}))")
    dy, dx = parts
    return F.expr(f"greatest({dy}, {dx})" if shape == "box" else f"sqrt({dy} * {dy} + {dx} * {dx})")


#: A cover starts with cells of this size and cuts each into 4 x 4 where it crosses the rim.
COARSEST, CUTS = 32.0, 4
#: The level of cells that are tested point by point.
RIM = -1


def cover_sizes(size: float) -> list[float]:
    """The sizes of a pyramid's cells, coarsest first, ``size`` last."""
    sizes = [size]
    while sizes[0] < COARSEST:
        sizes.insert(0, sizes[0] * CUTS)
    return sizes


def zone_cover(zones: DataFrame, size: float, shape: str) -> DataFrame:
    """One row per zone and cell of its cover: ``level`` (the place of its size in :func:`cover_sizes`, or ``RIM``)
    and ``cy, cx``. Each level is a step on the rows of the one before: no join, no shuffle."""
    sizes = cover_sizes(size)
    undecided = F.col("level") == RIM
    cells = touched_cells(zones, sizes[0], shape).withColumn("level", F.lit(RIM))
    for number, now in enumerate(sizes):
        if number:
            parts = f"explode(if(level = {RIM}, sequence(0, {CUTS * CUTS - 1}), array(0)))"
            cells = cells.selectExpr(*zones.columns, "level", "cy", "cx", f"{parts} AS part").selectExpr(
                *zones.columns,
                "level",
                f"if(level = {RIM}, cy * {CUTS} + part div {CUTS}, cy) AS cy",
                f"if(level = {RIM}, cx * {CUTS} + part % {CUTS}, cx) AS cx",
            )
            cells = cells.filter(~undecided | (_gap(now, shape, "near") <= F.col("radius") + SLACK))
        inside = undecided & (_gap(now, shape, "far") <= F.col("radius") - SLACK)
        cells = cells.withColumn("level", F.when(inside, number).otherwise(F.col("level")))
    return cells


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return located(points).withColumns({"cy": grid_cell("reclat", size), "cx": grid_cell("reclong", size)})


#: Zones and cells up to which the catalogue is searched where it lies.
FEW_ZONES, FEW_CELLS = 64, 50_000


def bounded(cells: DataFrame, most: int = FEW_CELLS) -> bool:
    """Whether there are at most so many cells; counts no further than that."""
    return cells.limit(most + 1).count() <= most


def near(obs: DataFrame, zones: DataFrame, many: bool = True) -> DataFrame:
    """Observations (or coordinates) that may lie in one of the zones (lat, lon, radius): all that do and some more.

    For up to ``FEW_ZONES`` zones their boxes become filters on coordinates, and on the space-order key
    ``place`` where the store has one, which files answer from their statistics. For more, a table of
    the touched square degrees (at most 181 x 361, the outermost standing for all beyond) is broadcast, or, without
    ``many``, all rows stay. Looks at the zones at once, so these should be a plain table."""
    rows = zones.select("lat", "lon", "radius").dropna()
    few = rows.limit(FEW_ZONES + 1).collect()
    if len(few) > FEW_ZONES:
        return _in_touched_degrees(obs, rows) if many else obs
    if not few:
        return obs.filter(F.lit(False))
    boxes = [(r.lat - r.radius - SLACK, r.lat + r.radius + SLACK, r.lon - r.radius - SLACK, r.lon + r.radius + SLACK) for r in few]
    return in_boxes(obs, boxes)


def in_boxes(obs: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows in one of a few boxes (south, north, west, east), by filters that the files can answer."""
    inside = [F.col("reclat").between(a, b) & F.col("reclong").between(c, d) for a, b, c, d in boxes]
    found = obs.filter(functools.reduce(Column.__or__, inside))
    if PLACE in obs.columns:
        runs = place_runs(boxes)
        found = found.filter(functools.reduce(Column.__or__, [F.col(PLACE).between(a, b) for a, b in runs]))
    return found


def _in_touched_degrees(obs: DataFrame, zones: DataFrame) -> DataFrame:
    def box(size: float, names: tuple[str, str]) -> dict[str, Column]:
        out = {}
        for name, centre, limit in zip(names, ("lat", "lon"), (90, 180)):
            ends = [F.floor((F.col(centre) + sign * (F.col("radius") + SLACK)) / size) for sign in (-1, 1)]
            low, high = math.floor(-limit / size), math.floor(limit / size)
            clamped = [F.greatest(F.least(e, F.lit(high)), F.lit(low)) for e in ends]
            out[name] = F.explode(F.sequence(*clamped))
        return out

    def listed(rows: DataFrame, size: float, names: tuple[str, str]) -> DataFrame:
        for name, column in box(size, names).items():
            rows = rows.withColumn(name, column)
        return rows.select(*names).distinct()

    wide = 8.0  # large zones list cells of this size first
    large = listed(zones.filter(F.col("radius") > wide), wide, ("wy", "wx"))
    for name, w in (("dy", "wy"), ("dx", "wx")):
        large = large.withColumn(name, F.explode(F.sequence(F.col(w) * int(wide), F.col(w) * int(wide) + int(wide) - 1)))
    cells = listed(zones.filter(F.col("radius") <= wide), 1.0, ("dy", "dx")).unionByName(large.select("dy", "dx")).distinct()
    own = [
        F.greatest(F.least(F.floor("reclat"), F.lit(90)), F.lit(-90)) == F.col("dy"),
        F.greatest(F.least(F.floor("reclong"), F.lit(180)), F.lit(-180)) == F.col("dx"),
    ]
    return obs.join(F.broadcast(cells), own, "left_semi")


#: Different coordinates in a square degree from which the rows of its cells are dealt over several tasks.
CROWDED = 1 << 16
#: Pairs of a row and a zone's cell in a square degree from which they are dealt over several tasks.
PAIRS = 1 << 24


def dealt(points: DataFrame, cells: DataFrame, size: float, most: int | None = None, pairs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (cy, cx) with a ``salt``: rows of ``points`` in crowded places draw one of as many
    as keep each below ``most`` rows (and below ``pairs`` pairs, if given), and ``cells`` there are listed for each
    of them. The table of crowded places is broadcast: there are at most 181 x 361 of them, however many points."""
    most = most or CROWDED
    ratio = max(1.0, 1.0 / size)
    high_y, high_x = math.floor(90 / max(size, 1.0)), math.floor(180 / max(size, 1.0))

    def degree(name: str, high: int) -> Column:
        return F.greatest(F.least(F.floor(F.col(name) / ratio), F.lit(high)), F.lit(-high - 1))

    key = {"_dy": degree("cy", high_y), "_dx": degree("cx", high_x)}
    crowds = points.groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.count(F.lit(1)).alias("_rows"))
    salts = F.col("_rows") / most
    if pairs:
        asked = cells.groupBy(*[c.alias(n) for n, c in key.items()]).agg(F.count(F.lit(1)).alias("_asked"))
        crowds = crowds.join(asked, ["_dy", "_dx"], "left")
        salts = F.greatest(salts, F.least(F.col("_rows"), F.col("_rows") / pairs * F.col("_asked")))
    crowds = F.broadcast(crowds.filter(salts > 1).select("_dy", "_dx", F.ceil(salts).alias("_salts")))
    drawn = points.withColumns(key).join(crowds, ["_dy", "_dx"], "left")
    drawn = drawn.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*points.columns), F.col("_salts")), F.lit(0).cast("long")))
    listed = cells.withColumns(key).join(crowds, ["_dy", "_dx"], "left")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1)
    return drawn.drop("_dy", "_dx", "_salts"), listed.withColumn("salt", F.explode(every)).drop("_dy", "_dx", "_salts")


def met(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``points`` (with their cell) and zone ``cells``, joined by cell."""
    if bounded(cells):
        return points.join(F.broadcast(cells), ["cy", "cx"])
    points, cells = dealt(points, cells, size, pairs=PAIRS)
    key = ("cy", "cx", "salt")
    return spread(points, *key).join(spread(cells, *key).hint("merge"), list(key)).drop("salt")


def within_zone(
    obs: DataFrame, zones: DataFrame, shape: str = "radius", cell: float = DEFAULT_CELL, keep: Sequence[str] = ()
) -> DataFrame:
    """Every (zone, observation) pair inside, with its ``distance``: the zone's ``location_id``
    (and ``keep`` columns) beside all columns of the observation."""
    zones = zones.select("location_id", "lat", "lon", "radius", *keep)
    cells = touched_cells(zones, cell, shape)
    return (
        met(with_cell(near(obs, zones), cell), cells, cell)
        .filter(in_zone(shape))
        .withColumn("distance", planar_distance(F.col("lat"), F.col("lon")))
        .select("location_id", *keep, *obs.columns, "distance")
    )


def with_radius(locations: DataFrame, radius: float | Column | None) -> DataFrame:
    if radius is None:
        return locations
    return locations.withColumn("radius", F.lit(float(radius)) if isinstance(radius, (int, float)) else radius)


def within_radius(obs: DataFrame, locations: DataFrame, radius: float | None = None) -> DataFrame:
    """Observations within ``radius`` degrees of each location (default: its ``radius`` column)."""
    return within_zone(obs, with_radius(locations, radius), "radius")


def within_box(obs: DataFrame, locations: DataFrame, radius: float | None = None) -> DataFrame:
    return within_zone(obs, with_radius(locations, radius), "box")


def rings(zones: DataFrame, factors: Sequence[float]) -> DataFrame:
    """Every zone once for each factor, which ``ring`` names, with its radius times that factor: zones about
    one centre share one list of cells and one join."""
    every = F.explode(F.array(*[F.lit(float(f)) for f in factors]))
    return zones.withColumn("ring", every).withColumn("radius", F.col("radius") * F.col("ring"))


# Summaries -----------------------------------------------------------------------------------

# What is kept per coordinate, and how two such rows merge.
COUNTS = {"n": "sum"}
MEASURES = {
    "n": "sum",
    "mass_sum": "sum",
    "log_sum": "sum",
    "fell": "sum",
    "found": "sum",
    "year_min": "min",
    "year_max": "max",
    "years": "sum",
    "year_sum": "sum",
    "year_sq": "sum",
    "lat_sum": "sum",
    "lat_sq": "sum",
    "lon_sum": "sum",
    "lon_sq": "sum",
}


def coordinate_counts(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per coordinate (and ``by``): the number of records. Partial counts form map-side."""
    return located(obs).groupBy("reclat", "reclong", *by).agg(F.count(F.lit(1)).alias("n"))


def coordinate_measures(obs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per coordinate (and ``by``) with everything the location scores need."""
    n = F.count(F.lit(1))
    year = F.col("year").cast("double")
    grouped = located(obs).groupBy("reclat", "reclong", *by).agg(
        n.alias("n"),
        F.sum("mass_g").alias("mass_sum"),
        F.sum(F.log10("mass_g")).alias("log_sum"),
        F.count_if(F.col("fall") == "Fell").alias("fell"),
        F.count_if(F.col("fall") == "Found").alias("found"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.count("year").alias("years"),
        F.sum(year).alias("year_sum"),
        F.sum(year * year).alias("year_sq"),
    )
    return grouped.withColumns(
        {
            "lat_sum": F.col("reclat") * F.col("n"),
            "lat_sq": F.col("reclat") * F.col("reclat") * F.col("n"),
            "lon_sum": F.col("reclong") * F.col("n"),
            "lon_sq": F.col("reclong") * F.col("reclong") * F.col("n"),
        }
    )


def merged(measures: dict[str, str]) -> list[Column]:
    return [MERGE[how](name).alias(name) for name, how in measures.items()]


def zone_summary(
    points: DataFrame,
    zones: DataFrame,
    zone_keys: Sequence[str] = ("location_id",),
    by: Sequence[str] = (),
    measures: dict[str, str] = COUNTS,
    shape: str = "radius",
    cell: float = DEFAULT_CELL,
    match: Sequence[str] = (),
    derived: bool = False,
) -> DataFrame:
    """Measures of all points inside each zone, per ``by`` value. Zones without points are absent.

    ``points`` has reclat, reclong, ``by`` and the measures. ``match`` names columns of ``by`` that
    the zones carry as well and that must agree (they become part of the join key). ``derived`` zones are
    results of other joins and are not looked at beforehand.
    """
    zone_keys, by, match = list(zone_keys), list(by), list(match)
    points = points if derived else near(points, zones, many=False)
    wanted = list(dict.fromkeys([*zone_keys, "lat", "lon", "radius", *match]))
    cells = zone_cover(zones.select(*wanted), cell, shape)
    single = with_cell(points, cell)
    # The pyramid: a coordinate counts to its cell on every level, mostly within the task.
    levels = ", ".join(
        f"struct({number} AS level, cy div {int(now / cell)} - if(cy % {int(now / cell)} < 0, 1, 0) AS cy, "
        f"cx div {int(now / cell)} - if(cx % {int(now / cell)} < 0, 1, 0) AS cx)"
        for number, now in enumerate(cover_sizes(cell))
    )
    nowhere = F.lit(None).cast("double")
    pyramid = (
        single.selectExpr(*by, *measures, f"inline(array({levels}))")
        .groupBy("level", "cy", "cx", *by)
        .agg(*merged(measures))
        .withColumns({"reclat": nowhere, "reclong": nowhere})
    )
    # Ready-made cell rows and single coordinates side by side: a covered cell meets the former, a
    # rim cell the latter, in one join over one list of cells.
    offered = single.withColumn("level", F.lit(RIM)).select(pyramid.columns).unionByName(pyramid)
    met = cells.hint("merge").join(offered, ["level", "cy", "cx", *match]).filter((F.col("level") != RIM) | in_zone(shape))
    return met.groupBy(*dict.fromkeys([*zone_keys, *by])).agg(*merged(measures))


def __getattr__(name: str):
    """``zone_median`` and ``zone_histogram`` are in :mod:`geoscope.operators.distributions`, which builds on this module."""
    if name in ("zone_median", "zone_histogram"):
        from geoscope.operators import distributions

        return getattr(distributions, name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
