"""Forecasts: per-location probabilities over the coming years, probability grids, yearly counts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoscope.functions import log_transform, probability_band
from geoscope.operators.blocks import met_in_blocks, tasks
from geoscope.operators.locations import _catalogue, proximity
from geoscope.operators.nearest import nearest_distance
from geoscope.operators.trends import year_counts
from geoscope.operators.zones import SLACK, coordinate_counts, zone_summary

# --- Fixed values: mass category, factor on the base rate, cap of the yearly probability ---
CATEGORIES = [("small", 2.0, 0.95), ("medium", 1.0, 0.75), ("large", 0.2, 0.25)]
THRESHOLDS = [0.25, 0.5, 0.75]
# --- end of fixed values ---


def temporal_base_rate(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Yearly base probability of each location, from the frequency of records in its radius and
    the nearness of the closest one. Year 0 (unknown) takes part in the span."""
    points = obs.groupBy("reclat", "reclong").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mass_g").alias("mass_sum"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )
    measures = {"n": "sum", "mass_sum": "sum", "year_min": "min", "year_max": "max"}
    zone = zone_summary(points, locations, measures=measures)
    span = F.col("year_max") - F.col("year_min")
    frequency = (
        F.when(F.col("n") == 0, F.lit(0.001)).when(span > 0, F.col("n") / span.cast("double")).otherwise(F.lit(0.01))
    )
    closeness = proximity(F.greatest(F.lit(0.1), F.col("d_min")))
    return (
        locations.select("location_id", "horizon")
        .join(zone, "location_id", "left")
        .fillna(0, subset=["n"])
        .join(nearest_distance(obs, locations), "location_id", "left")
        .withColumn("world", _catalogue(obs))
        .withColumn("frequency", frequency)
        .select(
            "location_id",
            "horizon",
            "n",
            F.when(F.col("n") > 0, F.col("mass_sum") / F.col("n")).otherwise(F.col("world.mean_mass")).alias("avg_mass"),
            "frequency",
            F.least(F.lit(0.5), F.col("frequency") * closeness).alias("base_rate"),
        )
    )


def yearly_series(base_rates: DataFrame) -> DataFrame:
    """One row per location and mass category with ``series``: an array over i = 0..horizon of
    (i, annual, cumulative). The horizon is at most 50, so the running value is folded within the
    row and no shuffle is needed."""
    categories = F.array(
        *[
            F.struct(F.lit(c).alias("category"), F.lit(f).alias("factor"), F.lit(cap).alias("cap"))
            for c, f, cap in CATEGORIES
        ]
    )
    rows = base_rates.select("location_id", "horizon", "base_rate", F.inline(categories))

    def annual(i: Column) -> Column:
        return F.least(F.col("cap"), F.col("base_rate") * F.col("factor") * (1 + i * 0.02))

    def step(done: Column, i: Column) -> Column:
        p = annual(i)
        before = F.element_at(done, -1)["cumulative"]
        reached = F.when(i == 0, p).otherwise(1 - (1 - p) * (1 - before))
        return F.array_append(done, F.struct(i.alias("i"), p.alias("annual"), reached.alias("cumulative")))

    first = F.array(
        F.struct(F.lit(0).alias("i"), annual(F.lit(0)).alias("annual"), annual(F.lit(0)).alias("cumulative"))
    )
    later = F.when(F.col("horizon") >= 1, F.sequence(F.lit(1), F.col("horizon"))).otherwise(
        F.array().cast("array<int>")
    )
    return rows.withColumn("series", F.aggregate(later, first, step))


def temporal_forecast(base_rates: DataFrame, as_of_year: int) -> DataFrame:
    """Location × category × year: annual and cumulative probability of at least one event."""
    return (
        yearly_series(base_rates)
        .select("location_id", "category", F.inline("series"))
        .withColumn("year", F.lit(as_of_year) + F.col("i"))
    )


def threshold_years(base_rates: DataFrame, as_of_year: int) -> DataFrame:
    """First year in which the cumulative probability reaches 25 / 50 / 75 %, null beyond the horizon."""

    def first_at(threshold: float) -> Column:
        reached = F.filter("series", lambda x: x["cumulative"] >= threshold)
        return F.lit(as_of_year) + F.try_element_at(reached, F.lit(1))["i"]

    return yearly_series(base_rates).select(
        "location_id", "category", *[first_at(t).alias(f"year_{int(t * 100)}") for t in THRESHOLDS]
    )


def horizon_milestones(base_rates: DataFrame, as_of_year: int) -> DataFrame:
    """Cumulative probability a third and two thirds into the horizon and at its end, with a band."""
    horizon = F.col("horizon")
    ahead = [
        F.greatest(F.lit(1), F.floor(horizon / 3).cast("int")),
        F.greatest(F.lit(2), F.floor(horizon * 2 / 3).cast("int")),
        horizon,
    ]
    points = F.array(
        *[
            F.struct(
                F.lit(k + 1).alias("milestone"),
                (F.lit(as_of_year) + a).alias("by_year"),
                F.element_at("series", F.least(a, horizon) + 1)["cumulative"].alias("probability"),
            )
            for k, a in enumerate(ahead)
        ]
    )
    return (
        yearly_series(base_rates)
        .select("location_id", "category", F.inline(points))
        .withColumn("band", probability_band("probability"))
    )


def expected_impacts(base_rates: DataFrame) -> DataFrame:
    """Sum of the annual probabilities over the horizon, its last year excluded."""
    total = F.aggregate(
        F.slice("series", F.lit(1), F.col("horizon")), F.lit(0.0), lambda done, x: done + x["annual"]
    )
    return yearly_series(base_rates).select("location_id", "category", total.alias("expected"))


# Probability grid ------------------------------------------------------------------------------------

GRID_STEPS = 80
MAX_DENSITY = 5.0
#: Pairs of a record and a grid row that are looked at together.
PAIRS_AT_ONCE = 1 << 20


def _grid_counts(steps: int):
    """For :func:`blocks.met_in_blocks`: the rows ``i`` of a zone's grid that observations of a block reach, with their
    counts at the columns 0 to ``steps``.

    Each observation marks where it starts and stops counting along a grid row; a running sum over a row's marks gives
    the counts. Where the row enters and leaves the disc around an observation is estimated; within rounding of a
    grid column the exact test decides."""

    def work(block, zones, at):
        lat, lon, radius = (zones[c][at] for c in ("lat", "lon", "radius"))
        step, reach = radius * 2 / steps, radius / 3
        if not step > 0:
            return None
        south, west = lat - radius, lon - radius
        row_lat = south + np.arange(steps + 1) * step
        wide = radius * (4.0 / 3.0) + SLACK
        y, x = block["reclat"], block["reclong"]
        low, high = np.searchsorted(y, lat - wide), np.searchsorted(y, lat + wide, "right")
        near = low + np.flatnonzero(np.abs(x[low:high] - lon) <= wide)
        y, x, n = y[near], x[near], block["n"][near]
        starts, ends = np.searchsorted(y, row_lat - reach - SLACK), np.searchsorted(y, row_lat + reach + SLACK, "right")
        marks = np.zeros((steps + 1, steps + 2))
        sizes, row = ends - starts, 0
        while row <= steps:  # as many rows at once as make some 2 ** 20 pairs, one at least
            until = max(row + 1, int(np.searchsorted(np.cumsum(sizes[row:]), PAIRS_AT_ONCE, "right")) + row)
            chosen, row = np.arange(row, until), until
            i = np.repeat(chosen, sizes[chosen])
            if len(i):
                before = np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen] - starts[chosen], sizes[chosen])
                k = np.arange(len(i)) - before
                _mark(marks, i, y[k] - row_lat[i], x[k], n[k], west, step, reach, steps)
        rows = np.flatnonzero(marks.any(axis=1))
        return {"i": rows, "counts": np.cumsum(marks[rows, :-1], axis=1).astype(np.int64)}

    return work


def _mark(marks, i, dy, x, n, west, step, reach, steps) -> None:
    """Adds the marks of observations at ``dy, x`` from the grid rows ``i`` and the meridian 0."""
    half = np.sqrt(np.maximum(reach * reach - dy * dy, 0.0))
    ends = []
    for at, rounded, order in (((x - half - west) / step, np.ceil, (-1, 0, 1)), ((x + half - west) / step, np.floor, (1, 0, -1))):
        end = rounded(at)
        unsure = np.flatnonzero(np.abs(at - np.rint(at)) <= 1e-5)
        settled = np.full(len(unsure), np.nan)
        for more in reversed(order):  # the first of the order that counts wins
            dx = x[unsure] - (west + (end[unsure] + more) * step)
            counts = np.sqrt(dy[unsure] * dy[unsure] + dx * dx) <= reach
            settled = np.where(counts, end[unsure] + more, settled)
        end[unsure] = settled
        ends.append(end)
    first, last = np.maximum(ends[0], 0), np.minimum(ends[1], steps)
    inside = first <= last  # never where one of them is not a number
    i, first, last, n = i[inside], first[inside].astype(np.int64), last[inside].astype(np.int64), n[inside]
    flat, width = marks.reshape(-1), marks.shape[1]
    flat += np.bincount(i * width + first, weights=n, minlength=flat.size)
    flat -= np.bincount(i * width + last + 1, weights=n, minlength=flat.size)


def spatial_probability_grid(obs: DataFrame, locations: DataFrame, steps: int = GRID_STEPS) -> DataFrame:
    """Probability on a (steps+1)² grid over each location's disc, from records within radius / 3.

    Records and locations meet in blocks of the globe (:mod:`geoscope.operators.blocks`), where a location's grid is
    counted row by row. A location leaves a block as the rows that the block's records reach, each an array of counts;
    the rows of its blocks are added up, and grid points are made last. Neither pairs nor points are shuffled.
    """
    zones = locations.select("location_id", "lat", "lon", "radius")
    number = tasks(zones)
    reach = F.col("radius") / 3

    def row_lat(i: Column) -> Column:
        return F.col("lat") - F.col("radius") + i * (F.col("radius") * 2 / steps)

    def column_lon(j: Column) -> Column:
        return F.col("lon") - F.col("radius") + j * (F.col("radius") * 2 / steps)

    counts = met_in_blocks(
        coordinate_counts(obs),
        zones,
        _grid_counts(steps),
        "i bigint, counts array<bigint>",
        reach=F.col("radius") * (4.0 / 3.0),
        number=number,
    )
    # A row of zeros opens every grid row.
    zero = F.lit(0).cast("long")
    zeros = F.array_repeat(zero, steps + 1)
    rows = F.explode(F.sequence(zero, F.lit(steps).cast("long")))
    opened = zones.select("location_id").distinct().select("location_id", rows.alias("i"), zeros.alias("counts"))
    added = F.aggregate(F.collect_list("counts"), zeros, lambda done, more: F.zip_with(done, more, lambda a, b: a + b))
    counted = (
        counts.unionByName(opened)
        .repartition(number, "location_id")
        .groupBy("location_id", "i")
        .agg(added.alias("counts"))
    )
    y, x = row_lat(F.col("i")), column_lon(F.col("j"))
    dy, dx = F.col("grid_lat") - F.col("lat"), F.col("grid_lon") - F.col("lon")
    density = F.col("n") / (math.pi * reach * reach)
    return (
        counted.join(zones, "location_id")
        .select("location_id", "lat", "lon", "radius", "i", F.posexplode("counts").alias("j", "n"))
        .withColumns({"grid_lat": y, "grid_lon": x})
        .withColumn("away", F.sqrt(dy * dy + dx * dx))
        .filter(F.col("away") <= F.col("radius"))
        .select(
            "location_id",
            F.col("i").cast("int").alias("i"),
            F.col("j").cast("int").alias("j"),
            "grid_lat",
            "grid_lon",
            "n",
            (F.least(F.lit(0.95), density / MAX_DENSITY) * (1 - F.col("away") / F.col("radius") * 0.3)).alias(
                "probability"
            ),
        )
    )


# Yearly counts -----------------------------------------------------------------------------------------

FORECAST_YEARS = 30
MIN_FIT_YEARS = 10


def count_forecast(obs: DataFrame, years_ahead: int = FORECAST_YEARS) -> DataFrame:
    """Cubic trend of the yearly counts, continued for ``years_ahead`` years with a ±20 % band.

    Empty when fewer than ten years are present. The least-squares cubic is summed up in closed form
    over orthogonal polynomials of the year, inside one row that holds a pair per year (plausible years
    bound their number). One lazy aggregate; nothing runs when the query is built.
    """
    pairs = F.struct(F.col("year").cast("double").alias("x"), F.col("n").cast("double").alias("n"))
    row = year_counts(obs, MIN_FIT_YEARS).agg(
        F.sort_array(F.collect_list(pairs)).alias("y"), F.max("year").alias("last"), F.count(F.lit(1)).cast("double").alias("s0")
    )

    def total(term) -> Column:
        return F.aggregate("y", F.lit(0.0), lambda sum_, e: sum_ + term(e["x"], e["n"]))

    def p1(x):
        return x - F.col("a0")

    def p2(x):
        return (x - F.col("a1")) * p1(x) - F.col("b1")

    def p3(x):
        return (x - F.col("a2")) * p2(x) - F.col("b2") * p1(x)

    row = row.filter("s0 > 0").withColumns({"a0": total(lambda x, n: x) / F.col("s0"), "k0": total(lambda x, n: n) / F.col("s0")})
    for k, p in ((1, p1), (2, p2), (3, p3)):
        row = row.withColumn(f"s{k}", total(lambda x, n, p=p: p(x) * p(x)))
        row = row.withColumn(f"k{k}", total(lambda x, n, p=p: n * p(x)) / F.col(f"s{k}"))
        row = row.withColumns(
            {f"a{k}": total(lambda x, n, p=p: x * p(x) * p(x)) / F.col(f"s{k}"), f"b{k}": F.col(f"s{k}") / F.col(f"s{k - 1}")}
        )
    future = row.drop("y").withColumn("year", F.explode(F.sequence(F.col("last") + 1, F.col("last") + years_ahead)))
    x = F.col("year").cast("double")
    n = F.col("k0") + F.col("k1") * p1(x) + F.col("k2") * p2(x) + F.col("k3") * p3(x)
    predicted = future.select(F.col("year").cast("int").alias("year"), n.alias("n"))
    return predicted.withColumns({"lower": F.col("n") * 0.8, "upper": F.col("n") * 1.2}).withColumns(
        {f"log_{c}": log_transform(c) for c in ("n", "lower", "upper")}
    )
