"""Distributions and summaries over (filtered) observations.

All are one grouped or global aggregate with map-side partials. Windows only ever run over
aggregated rows whose number is limited by the domain (families, years), never over records.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql.window import WindowSpec
from pyspark.sql import functions as F

from geoscope.functions import NO_FAMILY, class_group, share
from geoscope.operators.quantiles import exact_median

def everything() -> WindowSpec:
    """All rows as one frame; only for frames whose size the domain limits."""
    return Window.partitionBy()


def kpi_summary(obs: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: count, total / mean / median mass, distinct classes, year span.

    ``approximate`` trades the exact median and distinct count for one-pass sketches.
    """
    basics = [
        F.count(F.lit(1)).alias("n"),
        F.sum("mass_g").alias("total_mass"),
        F.avg("mass_g").alias("mean_mass"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    ]
    if approximate:
        return obs.agg(
            *basics,
            F.approx_count_distinct("recclass").alias("n_classes"),
            F.percentile_approx("mass_g", 0.5, 10_000).alias("median_mass"),
        )
    median = exact_median(obs, [], "mass_g", few_keys=True).select("median").scalar()
    return obs.agg(*basics, F.count_distinct("recclass").alias("n_classes")).withColumn("median_mass", median)


def kpi_fall_ratio(obs: DataFrame) -> DataFrame:
    """One row: count, total and mean mass, Fell / Found ratio (null without any Found)."""
    return (
        obs.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("mass_g").alias("total_mass"),
            F.avg("mass_g").alias("mean_mass"),
            F.count_if(F.col("fall") == "Fell").alias("fell"),
            F.count_if(F.col("fall") == "Found").alias("found"),
        )
        .withColumn("fell_found_ratio", share("fell", "found"))
        .fillna(0, subset=["total_mass", "mean_mass"])
    )


def _with_percent(counts: DataFrame) -> DataFrame:
    return counts.withColumn("percent", share("n", F.sum("n").over(everything())) * 100)


def class_group_share(obs: DataFrame, fixed_order: bool = False) -> DataFrame:
    """Count and percent per class family, largest first, the rest family last."""
    groups = obs.groupBy(class_group("recclass", fixed_order).alias("class_group"))
    counts = _with_percent(groups.agg(F.count(F.lit(1)).alias("n")))
    return counts.orderBy(F.col("class_group") == NO_FAMILY, F.desc("n"), "class_group")


def fall_share(obs: DataFrame) -> DataFrame:
    """Count and percent per fall type, by name."""
    return _with_percent(obs.groupBy("fall").agg(F.count(F.lit(1)).alias("n"))).orderBy("fall")


def minmax_scale(obs: DataFrame, point_size: float = 3.0) -> DataFrame:
    """Marker size of each observation: its log mass scaled to [3, 3 + 3·point_size].

    One repeated mass gives the midpoint, a single observation the largest size.
    """
    low, high = 3.0, 3.0 + 3.0 * point_size
    log_mass = F.log10("mass_g")
    extent = obs.agg(
        F.struct(F.min(log_mass).alias("low"), F.max(log_mass).alias("high"), F.count(F.lit(1)).alias("n"))
    ).scalar()
    span = F.col("_x.high") - F.col("_x.low")
    size = (
        F.when(F.col("_x.n") <= 1, F.lit(high))
        .when(span > 0, low + (log_mass - F.col("_x.low")) / span * (high - low))
        .otherwise(F.lit(low + (high - low) / 2))
    )
    return obs.withColumn("_x", extent).withColumn("point_size", size).drop("_x")


def mass_histogram(obs: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width histogram of log10 mass over its own range; every bin is listed."""
    values = obs.select(F.log10("mass_g").alias("v"))
    extent = values.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high"))).scalar()
    width = F.col("x.high") - F.col("x.low")
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("x.low")) / width * bins), F.lit(bins - 1)))
    counts = (
        values.withColumn("x", extent)
        .groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    all_bins = obs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("x", extent)
    return (
        all_bins.filter(F.col("x.low").isNotNull())
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("x.low") + width / bins * F.col("bin")).alias("low"),
            (F.col("x.low") + width / bins * (F.col("bin") + 1)).alias("high"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        )
    )


def top_classes(obs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent classes; ties by name."""
    return obs.groupBy("recclass").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "recclass").limit(k)


CORRELATED = ("mass_g", "reclat", "reclong", "year")


def correlation_matrix(
    obs: DataFrame, columns: tuple[str, ...] = CORRELATED, exclude_unknown_year: bool = False
) -> DataFrame:
    """Pearson correlation as rows (var_x, var_y, corr), from one aggregate.

    Year 0 (unknown) takes part unless ``exclude_unknown_year``. A constant column has no
    correlation, not even with itself.
    """
    source = obs.filter(F.col("year") > 0) if exclude_unknown_year else obs
    pairs = list(combinations(columns, 2))
    one = source.agg(
        # Spelled out, because ``corr`` itself fails on a constant column under ANSI arithmetic.
        *[
            F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{x}|{y}")
            for x, y in pairs
        ],
        *[F.when(F.max(c) > F.min(c), F.lit(1.0)).alias(f"{c}|{c}") for c in columns],
    )
    cells = []
    for x in columns:
        for y in columns:
            name = f"{x}|{y}" if x == y or (x, y) in pairs else f"{y}|{x}"
            cells.append(F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), F.col(name).alias("corr")))
    return one.select(F.inline(F.array(*cells)))


def density_grid(obs: DataFrame, cell: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per square cell of ``cell`` degrees: (cell_lat, cell_lon, n)."""
    return obs.groupBy(
        *keys,
        F.floor(F.col("reclat") / cell).alias("cell_lat"),
        F.floor(F.col("reclong") / cell).alias("cell_lon"),
    ).agg(F.count(F.lit(1)).alias("n"))

