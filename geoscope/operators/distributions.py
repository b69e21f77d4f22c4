"""Distributions of values within zones, counted block by block (:mod:`geoscope.operators.blocks`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoscope.operators.blocks import met_in_blocks, tasks, zone_bins, zone_compact_groups, zone_extent, zone_groups, zone_measures
from geoscope.operators.quantiles import bucket, middle_values, rank_buckets
from geoscope.operators.zones import MERGE, located, near

# log1p buckets of width 2**-4 per zone (some 250 up to 1e7), then 2**-11 (128 per first bucket), then the values.
ZONE_COARSE_BITS, ZONE_FINE_BITS = 4, 11

_ZONE = ["location_id", "lat", "lon", "radius"]


def _valued(obs: DataFrame, value: str) -> DataFrame:
    """One row per coordinate and distinct value."""
    rows = located(obs).filter(F.col(value).isNotNull()).select("reclat", "reclong", F.col(value).alias("value"))
    return rows.groupBy("reclat", "reclong", "value").agg(F.count(F.lit(1)).alias("n"))


def zone_median(obs: DataFrame, zones: DataFrame, value: str = "mass_g", shape: str = "radius") -> DataFrame:
    """Exact median of ``value`` per zone: (location_id, median).

    Three rounds of counting: in coarse buckets, in the fine ones of those that hold the middle ranks, and
    the values of the fine ones that do. A zone takes its buckets, with the ranks below them, into the next round.
    """
    zones = zones.select(*_ZONE)
    number = tasks(zones)
    points = _valued(near(obs, zones, many=False), value)
    points = points.withColumns({"b1": bucket("value", ZONE_COARSE_BITS), "b2": bucket("value", ZONE_FINE_BITS)})

    def counted(zones: DataFrame, by: str, kind: str, parent: str | None = None) -> DataFrame:
        columns = ["reclat", "reclong", "n", by, *([parent] if parent else [])]
        keep = ["location_id", *([parent, "total", "before"] if parent else [])]
        work = zone_groups([by], shape, parent)
        found = met_in_blocks(points.select(*columns), zones, work, f"`{by}` {kind}, n bigint", keep, shape, number=number)
        return found.groupBy(*keep, by).agg(F.sum("n").alias("n"))

    key = ["location_id"]
    coarse = rank_buckets(counted(zones, "b1", "bigint"), key, "b1")
    fine = rank_buckets(counted(zones.join(coarse, key), "b2", "bigint", "b1"), key, "b2", parent="b1")
    kind = points.schema["value"].dataType.simpleString()
    return middle_values(counted(zones.join(fine, key), "value", kind, "b2"), key, "value", parent="b2")


def zone_histogram(obs: DataFrame, zones: DataFrame, value: str, bins: int = 10, min_rows: int = 5, shape: str = "radius") -> DataFrame:
    """Equal-width histogram of ``value`` per zone over the zone's own range.

    Zones with fewer than ``min_rows`` records are left out; empty bins are not listed. The zones' ranges come
    first, then each block counts its records by the bins of every zone.
    """
    zones = zones.select(*_ZONE)
    number = tasks(zones)
    points = _valued(near(obs, zones, many=False), value).withColumn("value", F.col("value").cast("double"))
    extent = met_in_blocks(points, zones, zone_extent("value", shape), "lo double, hi double, total bigint", shape=shape, number=number)
    ranges = extent.groupBy("location_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))
    ranged = zones.join(ranges.filter(F.col("total") >= min_rows).drop("total"), "location_id")
    edges = ["location_id", "lo", "hi"]
    found = met_in_blocks(points, ranged, zone_bins("value", bins, shape), "bin int, n bigint", edges, shape, number=number)
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        found.groupBy(*edges, "bin")
        .agg(F.sum("n").alias("n"))
        .select(
            "location_id",
            "bin",
            (F.col("lo") + width * F.col("bin")).alias("low"),
            (F.col("lo") + width * (F.col("bin") + 1)).alias("high"),
            "n",
        )
    )


def zone_cells(points: DataFrame, zones: DataFrame, by: Sequence[str], shape: str, min_rows: int = 0) -> DataFrame:
    """Sums of ``n`` of the points in each zone by the columns ``by``, which go with places; of zones with ``min_rows``
    records and more."""
    zones = zones.select(*_ZONE)
    number = tasks(zones)
    points = points.select("reclat", "reclong", "n", *by)
    if min_rows:
        sums = met_in_blocks(points, zones, zone_compact_groups(by, shape, total=True), "total bigint", shape=shape, number=number)
        enough = sums.groupBy("location_id").agg(F.sum("total").alias("total")).filter(F.col("total") >= min_rows)
        zones = zones.join(enough, "location_id", "left_semi")
    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    found = met_in_blocks(points, zones, zone_compact_groups(by, shape), f"{kinds}, n bigint", shape=shape, number=number)
    return found.groupBy("location_id", *by).agg(F.sum("n").alias("n"))


def zone_measured(points: DataFrame, zones: DataFrame, by: str, measures: dict[str, str], shape: str) -> DataFrame:
    """Measures of the points in each zone by the column ``by``."""
    zones = zones.select(*_ZONE)
    columns = points.select("reclat", "reclong", by, *measures)
    result = ", ".join([f"`{by}` {points.schema[by].dataType.simpleString()}", *(f"`{m}` double" for m in measures)])
    found = met_in_blocks(columns, zones, zone_measures(by, measures, shape), result, shape=shape)
    known = {m: F.when(~F.isnan(m), F.col(m)).cast(points.schema[m].dataType) for m in measures}
    return found.withColumns(known).groupBy("location_id", by).agg(*[MERGE[how](m).alias(m) for m, how in measures.items()])
