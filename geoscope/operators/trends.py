"""Yearly and decade trends.

Each groups records by year or decade first. What follows runs over one row per year or
decade — at most as many as there are plausible years — so unpartitioned windows are cheap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoscope.functions import log_transform, share
from geoscope.operators.facets import everything
from geoscope.operators.filters import filter_year_valid
from geoscope.operators.quantiles import exact_median

TREND_START = 1800
ROLLING_ROWS = 5


def decade_counts(obs: DataFrame) -> DataFrame:
    return (
        obs.groupBy("decade").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", log_transform("n")).orderBy("decade")
    )


def year_counts(obs: DataFrame, min_years: int = 2) -> DataFrame:
    """Records per year after 1800; empty when fewer than ``min_years`` years are present."""
    counts = filter_year_valid(obs, TREND_START).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return with_enough_years(counts, min_years)


def with_enough_years(by_year: DataFrame, min_years: int) -> DataFrame:
    counted = by_year.withColumn("_years", F.count(F.lit(1)).over(everything()))
    return counted.filter(F.col("_years") >= min_years).drop("_years")


def year_trend(obs: DataFrame) -> DataFrame:
    """Per year: count, trailing mean over five present years, growth in percent against the
    previous present year, log count, and whether the year is a peak."""
    by_year = Window.orderBy("year")
    previous = F.lag("n").over(by_year)
    return (
        year_counts(obs)
        .withColumn("moving_avg", F.avg("n").over(by_year.rowsBetween(1 - ROLLING_ROWS, 0)))
        .withColumn("growth_rate", F.coalesce((share("n", previous) - 1) * 100, F.lit(0.0)))
        .withColumn("log_n", log_transform("n"))
        .withColumn("is_peak", F.col("n") > F.avg("n").over(everything()) + F.stddev_samp("n").over(everything()))
        .orderBy("year")
    )


def year_peaks(obs: DataFrame) -> DataFrame:
    """Years whose count exceeds the mean by more than one sample standard deviation."""
    return year_trend(obs).filter("is_peak").select("year", "n", "log_n")


def decade_fall_pivot(obs: DataFrame) -> DataFrame:
    """Per decade: Fell and Found counts and mean masses side by side, total, percent Fell, logs."""
    fell, found = F.col("fall") == "Fell", F.col("fall") == "Found"
    grouped = (
        filter_year_valid(obs, TREND_START)
        .groupBy("decade")
        .agg(
            F.count_if(fell).alias("fell"),
            F.count_if(found).alias("found"),
            F.coalesce(F.avg(F.when(fell, F.col("mass_g"))), F.lit(0.0)).alias("mean_mass_fell"),
            F.coalesce(F.avg(F.when(found, F.col("mass_g"))), F.lit(0.0)).alias("mean_mass_found"),
            F.min("year").alias("_lo"),
            F.max("year").alias("_hi"),
        )
    )
    return (
        grouped.withColumn("_span", F.max("_hi").over(everything()) - F.min("_lo").over(everything()))
        .filter(F.col("_span") > 0)
        .drop("_lo", "_hi", "_span")
        .withColumn("total", F.col("fell") + F.col("found"))
        .withColumn("pct_fell", F.coalesce(share("fell", "total") * 100, F.lit(0.0)))
        .withColumns({f"log_{c}": log_transform(c) for c in ("fell", "found", "total")})
        .orderBy("decade")
    )


def decade_fall_mass(obs: DataFrame) -> DataFrame:
    """Mean, count and sum of mass per decade and fall type, years after 1800."""
    return (
        filter_year_valid(obs, TREND_START)
        .groupBy("decade", "fall")
        .agg(
            F.avg("mass_g").alias("mean_mass"),
            F.count(F.lit(1)).alias("n"),
            F.sum("mass_g").alias("total_mass"),
        )
    )


def mass_by_year(obs: DataFrame) -> DataFrame:
    """Mean and exact median mass per year after 1800, with logs; needs two different years."""
    dated = filter_year_valid(obs, TREND_START)
    means = dated.groupBy("year").agg(F.avg("mass_g").alias("mean_mass"), F.count(F.lit(1)).alias("n"))
    medians = exact_median(dated, ["year"], "mass_g", few_keys=True).withColumnRenamed("median", "median_mass")
    return (
        with_enough_years(means, 2)
        .join(medians, "year")
        .withColumn("log_mean", log_transform("mean_mass"))
        .withColumn("log_median", log_transform("median_mass"))
        .orderBy("year")
    )
