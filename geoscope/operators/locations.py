"""Scores and statistics of many query locations at once.

``locations`` has location_id, lat, lon, and the parameters an operator names (radius, horizon,
detection, env_factor, hist_weight, complexity). Results have one row per location unless stated.
Counts and sums come from ``zones.zone_summary``, distances from ``nearest.nearest_distance``;
the scores are column expressions over that one row per location.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoscope.functions import clamp, confidence_tier, reliability_tier, share
from geoscope.operators.distributions import zone_cells, zone_histogram, zone_measured, zone_median
from geoscope.operators.nearest import nearest_distance
from geoscope.operators.zones import (
    DEFAULT_CELL,
    MEASURES,
    MERGE,
    coordinate_counts,
    coordinate_measures,
    rings,
    with_radius,
    zone_summary,
)

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0

REGION_FACTOR = 3.0
# Zones together with their regions reach far, so their rims are tested in cells of this size.
REGION_CELL = 1.0
RELIABILITY_RADIUS = 5.0


def _zone_n(
    obs: DataFrame,
    locations: DataFrame,
    radius: float | Column | None = None,
    shape: str = "radius",
    name: str = "n",
    cell: float = DEFAULT_CELL,
) -> DataFrame:
    """(location_id, count) for every location, zero included."""
    zones = with_radius(locations.select("location_id", "lat", "lon", *_has(locations, "radius")), radius)
    counts = zone_summary(coordinate_counts(obs), zones, shape=shape, cell=cell)
    return (
        locations.select("location_id")
        .join(counts, "location_id", "left")
        .select("location_id", F.coalesce("n", F.lit(0).cast("long")).alias(name))
    )


def _has(df: DataFrame, name: str) -> list[str]:
    return [name] if name in df.columns else []


def _known_years(obs: DataFrame) -> DataFrame:
    """Year 0 (unknown) as null, so that no year figure counts it."""
    return obs.withColumn("year", F.when(F.col("year") > 0, F.col("year")))


def _facts(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """All locations with the measures of their radius zone (null sums and zero counts when empty)."""
    measures = zone_summary(coordinate_measures(obs), locations, measures=MEASURES)
    return locations.join(measures, "location_id", "left").fillna(0, subset=["n", "fell", "found"])


def _catalogue(obs: DataFrame) -> Column:
    """Size and mean mass of the whole catalogue as a one-row subquery."""
    return obs.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("mass_g").alias("mean_mass"))).scalar()


def proximity(d_min: Column) -> Column:
    return clamp(F.lit(1.0) / (d_min + 0.1), 0.1, 1.0)


# Reliability and impact scores -------------------------------------------------------------------


def reliability_index(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """0-100: nearness of the closest record (40 %), records within 5° (40 %), land (20 %, always)."""
    near = _zone_n(obs, locations.drop("radius"), RELIABILITY_RADIUS, name="n_near")
    distances = nearest_distance(obs, locations)
    closeness = F.greatest(F.lit(0.0), 100 - F.col("d_min") * 10)
    density = F.least(F.lit(100.0), F.col("n_near") * 2.0)
    return (
        near.join(distances, "location_id", "left")
        .withColumn("reliability", (closeness * 0.4 + density * 0.4 + F.lit(100 * 0.2)).cast("int"))
        .withColumn("tier", reliability_tier("reliability"))
    )


def impact_scores(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Impact probability, confidence and the factors behind them, in one row per location.

    The fall factor is reported but enters no score.
    """
    rows = locations.select("location_id", "horizon", "detection")
    rows = rows.join(_zone_n(obs, locations), "location_id")
    rows = rows.join(nearest_distance(obs, locations), "location_id", "left")
    rows = rows.withColumns(
        {
            "proximity_factor": proximity(F.col("d_min")),
            "density_factor": F.least(F.lit(1.0), F.col("n") / 20.0),
            "time_factor": clamp(F.col("horizon") / 100.0, 0.3, 0.8),
            "fall_factor": F.when(F.col("detection") == "Fell", F.lit(1.2)).otherwise(F.lit(1.0)),
        }
    )
    confidence = (
        F.col("proximity_factor") * 0.35 + F.col("density_factor") * 0.45 + (1 - F.col("time_factor")) * 0.2
    ) * 100
    return rows.withColumns(
        {
            "impact_probability": _impact_probability(F.col("density_factor"), F.col("horizon")),
            "confidence": confidence.cast("int"),
        }
    ).withColumn("tier", confidence_tier("confidence"))


def _impact_probability(density_factor: Column, horizon: Column) -> Column:
    return F.least(F.lit(0.15), F.lit(0.02) * (0.5 + density_factor * 1.5) * (0.5 + horizon / 20.0))


def impact_probability(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Needs no nearest distance, so it is planned without that join."""
    rows = locations.select("location_id", "horizon").join(_zone_n(obs, locations), "location_id")
    density = F.least(F.lit(1.0), F.col("n") / 20.0)
    return rows.select("location_id", "n", _impact_probability(density, F.col("horizon")).alias("impact_probability"))


def impact_confidence(obs: DataFrame, locations: DataFrame) -> DataFrame:
    return impact_scores(obs, locations).select("location_id", "confidence", "tier")


def impact_factors(obs: DataFrame, locations: DataFrame) -> DataFrame:
    return impact_scores(obs, locations).select(
        "location_id", "proximity_factor", "density_factor", "time_factor", "fall_factor"
    )


# Zone statistics ------------------------------------------------------------------------------------


def zone_class_counts(obs: DataFrame, locations: DataFrame, shape: str = "radius") -> DataFrame:
    """(location_id, recclass, n) inside each zone."""
    return zone_summary(coordinate_counts(obs, ["recclass"]), locations, by=["recclass"], shape=shape)


def _ranked_classes(counts: DataFrame) -> DataFrame:
    order = Window.partitionBy("location_id").orderBy(F.desc("n"), "recclass")
    return counts.withColumn("rank", F.row_number().over(order))


def zone_statistics(
    obs: DataFrame, locations: DataFrame, as_of_year: int, shape: str = "box", exclude_unknown_year: bool = False
) -> DataFrame:
    """Statistics of every zone that holds records.

    Count, total / mean / median mass, first and last year, mean age in whole years, the three main
    classes (from three records on), share of the dominant class, records per square degree, and
    the share of the surrounding region (three times the radius). Year 0 (unknown) is in the years and ages
    unless ``exclude_unknown_year``; a zone without a known year then has none.
    """
    if exclude_unknown_year:
        obs = _known_years(obs)
    kept = ("n", "mass_sum", "year_min", "year_max", "years", "year_sum")
    measures = {k: MEASURES[k] for k in kept}
    # The zone itself meets coordinates by class, its region bare counts.
    zones = locations.select("location_id", "lat", "lon", "radius")
    by_class = zone_measured(coordinate_measures(obs, ["recclass"]), zones, "recclass", measures, shape)
    region = zone_summary(coordinate_counts(obs), with_radius(zones, F.col("radius") * REGION_FACTOR), shape=shape, cell=REGION_CELL)
    counts = by_class.withColumn("ring", F.lit(1.0)).unionByName(region.withColumn("ring", F.lit(REGION_FACTOR)), allowMissingColumns=True)
    own = F.col("ring") == 1.0

    def inside(name: str) -> Column:
        return F.when(own, F.col(name))

    order = Window.partitionBy("location_id", "ring").orderBy(F.desc("n"), "recclass")
    basics = (
        counts.withColumn("rank", F.row_number().over(order))
        .groupBy("location_id")
        .agg(
            *[MERGE[MEASURES[k]](inside(k)).alias(k) for k in kept],
            F.sum(F.when(~own, F.col("n"))).alias("n_region"),
            F.sort_array(F.collect_list(F.when(own & (F.col("rank") <= 3), F.struct("rank", "recclass")))).alias("_main"),
            F.max(inside("n")).alias("_top"),
        )
        .filter(F.col("n") > 0)
    )
    medians = zone_median(obs, locations, "mass_g", shape).withColumnRenamed("median", "median_mass")
    enough = F.col("n") >= 3
    return (
        locations.select("location_id", "radius")
        .join(basics, "location_id")
        .join(medians, "location_id")
        .select(
            "location_id",
            "n",
            F.col("mass_sum").alias("total_mass"),
            (F.col("mass_sum") / F.col("n")).alias("mean_mass"),
            "median_mass",
            F.col("year_min").alias("first_year"),
            F.col("year_max").alias("last_year"),
            (as_of_year - F.try_divide("year_sum", "years")).cast("int").alias("mean_age"),
            F.when(enough, F.array_join("_main.recclass", ", ")).alias("main_classes"),
            F.when(enough, F.col("_main")[0]["recclass"]).alias("dominant_class"),
            F.when(enough, share("_top", "n") * 100).alias("dominant_share"),
            (F.col("n") / (math.pi * F.col("radius") * F.col("radius"))).alias("concentration"),
            "n_region",
            (share("n", "n_region") * 100).alias("region_share"),
        )
    )


HIGH_CONCENTRATION = 0.1


def zone_observations(obs: DataFrame, locations: DataFrame, shape: str = "box") -> DataFrame:
    """Share of the catalogue in each zone that holds records, and whether its concentration, to two
    decimals, is above 0.1 per square degree."""
    counts = _zone_n(obs, locations, shape=shape).filter(F.col("n") > 0)
    concentration = F.col("n") / (math.pi * F.col("radius") * F.col("radius"))
    return (
        counts.join(locations.select("location_id", "radius"), "location_id")
        .withColumn("catalogue", _catalogue(obs))
        .select(
            "location_id",
            "n",
            (share("n", "catalogue.n") * 100).alias("catalogue_share"),
            concentration.alias("concentration"),
            (F.round(concentration, 2) > HIGH_CONCENTRATION).alias("above"),
        )
    )


def region_comparison(obs: DataFrame, locations: DataFrame, shape: str = "box", units: str = "mixed") -> DataFrame:
    """Local, regional (3x radius) and global counts and densities, three rows per location.

    ``relative_density`` is relative to the largest of the three. As in ``units="mixed"``, local and
    regional densities are per square degree but the global one per km²; ``units="km2"`` puts all
    three on km². Empty box zones are left out, empty radius zones are kept.
    """
    if units not in ("mixed", "km2"):
        raise ValueError(f"unknown units {units}")
    found = zone_summary(
        coordinate_counts(obs),
        rings(locations.select("location_id", "lat", "lon", "radius"), (1.0, REGION_FACTOR)),
        ["location_id", "ring"],
        shape=shape,
        cell=REGION_CELL,
    )
    counts = found.groupBy("location_id").agg(
        F.sum(F.when(F.col("ring") == 1.0, F.col("n"))).alias("n_local"), F.sum(F.when(F.col("ring") != 1.0, F.col("n"))).alias("n_region")
    )
    per_degree = KM_PER_DEGREE**2 if units == "km2" else 1.0
    area = math.pi * F.col("radius") * F.col("radius") * per_degree
    rows = (
        locations.select("location_id", "radius")
        .join(counts, "location_id", "left")
        .fillna(0, ["n_local", "n_region"])
        .withColumn("n_global", _catalogue(obs)["n"])
    )
    if shape == "box":
        rows = rows.filter(F.col("n_local") > 0)
    return (
        rows.withColumns(
            {
                "d_local": F.col("n_local") / area,
                "d_region": F.col("n_region") / (area * REGION_FACTOR**2),
                "d_global": F.col("n_global") / F.lit(4 * math.pi * EARTH_RADIUS_KM**2),
            }
        )
        .withColumn("top", F.greatest("d_local", "d_region", "d_global"))
        .select(
            "location_id",
            "top",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(s).alias("scope"), F.col(f"n_{s}").alias("n"), F.col(f"d_{s}").alias("density")
                        )
                        for s in ("local", "region", "global")
                    ]
                )
            ),
        )
        .withColumn("relative_density", F.coalesce(share("density", "top"), F.lit(0.0)))
        .drop("top")
    )


MIN_ZONE_ROWS = 5


def zone_top_types(obs: DataFrame, locations: DataFrame, k: int = 5, shape: str = "box") -> DataFrame:
    """The k most frequent classes of every zone with at least five records; ties by name."""
    whole = Window.partitionBy("location_id")
    counts = zone_class_counts(obs, locations, shape).withColumn("total", F.sum("n").over(whole))
    enough = counts.filter(F.col("total") >= MIN_ZONE_ROWS).drop("total")
    return _ranked_classes(enough).filter(F.col("rank") <= k)


def zone_mass_histogram(obs: DataFrame, locations: DataFrame, bins: int = 10, shape: str = "box") -> DataFrame:
    """Histogram of log10 mass per zone with at least five records."""
    logs = obs.select("reclat", "reclong", F.log10("mass_g").alias("log10_mass"))
    return zone_histogram(logs, locations, "log10_mass", bins, MIN_ZONE_ROWS, shape)


def zone_timeline(obs: DataFrame, locations: DataFrame, shape: str = "box") -> DataFrame:
    """Records per decade of every zone with at least five records of known year."""
    dated = obs.filter(F.col("year") > 0)
    counts = zone_summary(coordinate_counts(dated, ["decade"]), locations, by=["decade"], shape=shape)
    whole = Window.partitionBy("location_id")
    return (
        counts.withColumn("total", F.sum("n").over(whole)).filter(F.col("total") >= MIN_ZONE_ROWS).drop("total")
    )


def zone_density(obs: DataFrame, locations: DataFrame, cell: float = 0.25, shape: str = "radius") -> DataFrame:
    """Counts per small cell around each location: within twice the radius and only from five records
    on (``radius``), or within the square zone (``box``)."""
    points = coordinate_counts(obs).withColumns(
        {"cell_lat": F.floor(F.col("reclat") / cell), "cell_lon": F.floor(F.col("reclong") / cell)}
    )
    zones = with_radius(locations, F.col("radius") * 2.0) if shape == "radius" else locations
    return zone_cells(points, zones, ["cell_lat", "cell_lon"], shape, MIN_ZONE_ROWS if shape == "radius" else 0)


# Fall probabilities, mass, class, confidence ----------------------------------------------------------


def fall_probabilities(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Probability of a found and of a fallen specimen from the local shares, the local density
    against the global one, the horizon and the two user weights."""
    counts = zone_summary(
        coordinate_measures(obs).select("reclat", "reclong", "n", "fell", "found"),
        locations,
        measures={"n": "sum", "fell": "sum", "found": "sum"},
    )
    rows = locations.join(counts, "location_id", "left").fillna(0, subset=["n", "fell", "found"])
    found, fell = F.col("p_found"), F.col("p_fell")
    few = F.col("n") < 5
    close = ~few & (F.abs(found - fell) < 0.05)
    found_leads = found > fell
    density = F.col("n") / (math.pi * F.col("radius") * F.col("radius"))
    world = F.col("world.n") / (180.0 * 360.0)
    weights = (0.7 + F.col("env_factor") * 0.3, 0.7 + F.col("hist_weight") * 0.3)
    time = F.least(F.lit(1.5), 1 + F.col("horizon") / 100.0)
    both = found + fell
    return (
        rows.withColumn("world", _catalogue(obs))
        .withColumn("ratio", F.least(F.lit(3.0), density / (world + 0.0001)))
        # shares of the zone, weighted by how dense it is
        .withColumns(
            {
                "p_found": F.when(few, 0.05).otherwise(
                    F.least(F.lit(0.95), share("found", "n") * F.col("ratio") * 0.7)
                ),
                "p_fell": F.when(few, 0.02).otherwise(F.least(F.lit(0.5), share("fell", "n") * F.col("ratio") * 0.3)),
            }
        )
        # keep the two apart
        .withColumns(
            {
                "p_found": F.when(
                    close, F.when(found_leads, found + 0.05).otherwise(F.greatest(F.lit(0.01), found - 0.03))
                ).otherwise(found),
                "p_fell": F.when(
                    close, F.when(found_leads, F.greatest(F.lit(0.01), fell - 0.03)).otherwise(fell + 0.05)
                ).otherwise(fell),
            }
        )
        .withColumns({"p_found": F.least(F.lit(0.95), found * time), "p_fell": F.least(F.lit(0.7), fell * time)})
        .withColumns(
            {
                "p_found": F.least(F.lit(0.95), found * weights[0] * weights[1]),
                "p_fell": F.least(F.lit(0.7), fell * weights[0] * weights[1]),
            }
        )
        # together at most 95 % once they exceed 1
        .withColumn("shrink", F.when(both > 1.0, F.lit(0.95) / both).otherwise(F.lit(1.0)))
        .select(
            "location_id",
            "n",
            (found * F.col("shrink")).alias("p_found"),
            (fell * F.col("shrink")).alias("p_fell"),
        )
    )


MIN_ESTIMATE_ROWS = 6


def estimated_mass(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """Geometric mean mass around each location; null with five records or fewer."""
    logs = obs.groupBy("reclat", "reclong").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.log10("mass_g")).alias("log_sum")
    )
    sums = zone_summary(logs, locations, measures={"n": "sum", "log_sum": "sum"})
    mean_log = F.col("log_sum") / F.col("n")
    return (
        locations.select("location_id")
        .join(sums, "location_id", "left")
        .select(
            "location_id",
            F.when(F.col("n") >= MIN_ESTIMATE_ROWS, F.pow(F.lit(10.0), mean_log)).alias("estimated_mass"),
        )
    )


def _modal_class(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """(location_id, n, top class, its count) of zones with records; ties by name."""
    best = F.min(F.struct((-F.col("n")).alias("order"), F.col("recclass"))).alias("best")
    return (
        zone_class_counts(obs, locations)
        .groupBy("location_id")
        .agg(F.sum("n").alias("n"), best)
        .select("location_id", "n", F.col("best.recclass").alias("top_class"), (-F.col("best.order")).alias("top_n"))
    )


def probable_class(obs: DataFrame, locations: DataFrame) -> DataFrame:
    """The most frequent class around each location; null with five records or fewer."""
    return (
        locations.select("location_id")
        .join(_modal_class(obs, locations), "location_id", "left")
        .select("location_id", F.when(F.col("n") >= MIN_ESTIMATE_ROWS, F.col("top_class")).alias("probable_class"))
    )


def _sample_std(total: str, squares: str, count: str = "n") -> Column:
    """Sample standard deviation from n, Σx and Σx²."""
    n, s = F.col(count), F.col(total)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(squares) - s * s / n, n - 1)))


def confidence_score(obs: DataFrame, locations: DataFrame, exclude_unknown_year: bool = False) -> DataFrame:
    """0-100 from data volume, horizon, spread in time and space, class dominance and user settings.

    Year 0 (unknown) is part of the spread in time unless ``exclude_unknown_year``."""
    if exclude_unknown_year:
        obs = _known_years(obs)
    modal = _modal_class(obs, locations).select("location_id", "top_n")
    rows = _facts(obs, locations).join(modal, "location_id", "left")
    n = F.col("n")
    years = F.col("year_max") - F.col("year_min")
    dispersion = (_sample_std("lat_sum", "lat_sq") + _sample_std("lon_sum", "lon_sq")) / 2
    dominance = share("top_n", "n")
    time_bonus = F.when(
        n > 5,
        F.when((years > 50) & (_sample_std("year_sum", "year_sq", "years") > 15), 15).when(years > 20, 10).otherwise(0),
    ).otherwise(0)
    space_bonus = F.when(n > 10, F.when(dispersion > 0.5, 10).when(dispersion > 0.2, 5).otherwise(0)).otherwise(0)
    class_bonus = F.when(n > 5, F.when(dominance > 0.7, 10).when(dominance > 0.5, 5).otherwise(0)).otherwise(0)
    base = 50 + F.least(F.lit(1.0), n / 50.0) * 30
    penalty = F.least(F.lit(40.0), F.col("horizon") * 0.8)
    settings = (
        (0.8 + (1 - F.abs(F.col("complexity") - 5) / 10.0) * 0.3)
        * (0.9 + F.col("env_factor") * 0.2)
        * (0.9 + F.col("hist_weight") * 0.2)
    )
    return rows.withColumn(
        "score", clamp((base - penalty + time_bonus + space_bonus + class_bonus) * settings, 0, 100)
    ).select("location_id", "n", "horizon", "radius", "complexity", "score")


def confidence_reason(scored: DataFrame) -> DataFrame:
    """Adds ``reason``, a code for why the score of ``confidence_score`` is what it is."""
    score, horizon = F.col("score"), F.col("horizon")
    low = (
        F.when(horizon > 30, "low_far_horizon").when(F.col("radius") < 2, "low_small_radius").otherwise("low_sparse_data")
    )
    off_complexity = (F.col("complexity") > 8) | (F.col("complexity") < 3)
    medium = (
        F.when(horizon > 15, "medium_long_horizon")
        .when(off_complexity, "medium_complexity")
        .otherwise("medium_distribution")
    )
    return scored.withColumn("reason", F.when(score < 30, low).when(score < 70, medium).otherwise("high"))
