"""Faceted filters. Each is a plain predicate, so Catalyst pushes it into the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MASS_EXPONENTS = (0, 6)
DEFAULT_DECADES = (1800, 2020)


def filter_mass(obs: DataFrame, exponents: Sequence[float] | None) -> DataFrame:
    """Keep 10**lo ≤ mass ≤ 10**hi. A range that is no pair of numbers is ignored."""
    if not exponents:
        return obs
    try:
        low, high = float(10 ** exponents[0]), float(10 ** exponents[1])
    except (TypeError, ValueError):
        return obs
    return obs.filter(F.col("mass_g").between(low, high))


def _equals_or_in(obs: DataFrame, name: str, wanted: str | Iterable[str] | DataFrame) -> DataFrame:
    """A value or a list of values is one predicate; a table of values (its column ``name``) is a semi join,
    which Spark broadcasts only when it is measured small."""
    if isinstance(wanted, DataFrame):
        listed = wanted.select(F.col(name).alias("_wanted"))
        return obs.join(listed, F.col(name) == F.col("_wanted"), "left_semi").select(*obs.columns)
    if isinstance(wanted, str):
        return obs.filter(F.col(name) == wanted)
    return obs.filter(F.col(name).isin(list(dict.fromkeys(wanted))))


def filter_class(obs: DataFrame, classes: str | Iterable[str] | DataFrame | None) -> DataFrame:
    """'all', None or an empty list keep everything; ['all'] is a list and matches nothing."""
    if not isinstance(classes, DataFrame) and (not classes or classes == "all"):
        return obs
    return _equals_or_in(obs, "recclass", classes)


def filter_fall(obs: DataFrame, falls: str | Iterable[str] | DataFrame | None) -> DataFrame:
    return _equals_or_in(obs, "fall", falls) if isinstance(falls, DataFrame) or falls else obs


def filter_decade(obs: DataFrame, decades: Sequence[int] | None) -> DataFrame:
    if not decades:
        return obs
    try:
        low, high = int(decades[0]), int(decades[1])
    except (TypeError, ValueError):
        return obs
    return obs.filter(F.col("decade").between(low, high))


def filter_year(obs: DataFrame, years: Sequence[int]) -> DataFrame:
    low, high = int(years[0]), int(years[1])
    # The decade follows from the year; naming it too lets a decade-partitioned table skip files.
    decades = F.col("decade").between(low // 10 * 10, high // 10 * 10)
    return obs.filter(decades & F.col("year").between(low, high))


def filter_year_valid(obs: DataFrame, after: int = 1800) -> DataFrame:
    """Keep years strictly after ``after`` (1800 for trends, 0 for 'any known year')."""
    return obs.filter((F.col("decade") >= after // 10 * 10) & (F.col("year") > after))


def filter_obs(
    obs: DataFrame,
    mass_range: Sequence[float] | None = None,
    classification: str | Iterable[str] | None = None,
    fall_type: str | Iterable[str] | None = None,
    decade_range: Sequence[int] | None = None,
) -> DataFrame:
    """All facets at once; a facet left empty does not filter."""
    out = filter_mass(obs, mass_range)
    out = filter_class(out, classification)
    out = filter_fall(out, fall_type)
    return filter_decade(out, decade_range)


def cross_filter(obs: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep observations whose id is selected. ``selection`` may have duplicates and any size:
    Spark broadcasts it only when it is measured small."""
    return obs.join(selection.select("id"), "id", "left_semi").select(*obs.columns)


MAX_HORIZON = 50


def location_problem() -> Column:
    """Why a location row cannot be scored; null when it can."""
    lat, lon, horizon, detection = F.col("lat"), F.col("lon"), F.col("horizon"), F.col("detection")

    def fails(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    return (
        F.when(fails(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)), "coordinates")
        .when(fails(horizon.between(1, MAX_HORIZON)), "horizon")
        .when(fails(detection.isin("Fell", "Found", "all")), "detection")
    )


def valid_locations(locations: DataFrame) -> DataFrame:
    return locations.filter(location_problem().isNull())


def quarantine_locations(locations: DataFrame) -> DataFrame:
    return locations.withColumn("reason", location_problem()).filter(F.col("reason").isNotNull())
