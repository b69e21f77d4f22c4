"""Key figures from stored sketches: written once, merged by filter, without another look at the catalogue.

For every decade and fall type the store keeps one row: counts and sums, the year span, a HyperLogLog sketch of the
classes, and the masses counted in buckets. A bucket ends at a power of ``GROWTH``, so its middle is off by at
most ``ERROR`` of any mass in it. A median taken from merged buckets is the exact middle ranks' buckets, as
counts are exact; hence it is within ``ERROR`` (1 %) of the exact median, whatever the masses.

Rows merge by sums, extremes, union of sketches and sums of buckets, so rows of new records are simply appended.
The size of the store follows from the domain (decades, fall types, buckets), not from the catalogue.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoscope.operators.filters import filter_decade, filter_fall

#: A bucket's middle is off by at most this share of any mass in it.
ERROR = 0.01
GROWTH = (1 + ERROR) / (1 - ERROR)
#: Masses that are not positive share the bucket of zero.
ZERO = -(1 << 20)
#: 2 to this power registers: a standard error of 1.04 / 64 = 1.6 %, and none for up to some hundred classes.
CLASS_BITS = 12

SCHEMA = (
    "decade int, fall string, n bigint, masses bigint, mass_sum double, min_year int, max_year int, classes binary, "
    "buckets array<struct<bucket: bigint, n: bigint>>"
)


def mass_bucket(mass: Column) -> Column:
    return F.when(mass > 0, F.ceil(F.log(mass) / math.log(GROWTH))).otherwise(F.lit(ZERO).cast("bigint"))


def bucket_mass(bucket: Column) -> Column:
    """The mass that is within ``ERROR`` of every mass of the bucket."""
    return F.when(bucket > ZERO, 2 / (GROWTH + 1) * F.pow(F.lit(GROWTH), bucket)).when(bucket == ZERO, 0.0)


def kpi_sketches(obs: DataFrame) -> DataFrame:
    """One row for each decade and fall type. Records without a mass count, but not among the masses. Records are
    first counted by bucket, within their tasks mostly, so a decade that holds most of them is few rows."""
    key = ["decade", "fall"]
    by_bucket = obs.groupBy(*key, F.when(F.col("mass_g").isNotNull() & ~F.isnan("mass_g"), mass_bucket(F.col("mass_g"))).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("mass_g").alias("mass_sum"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.hll_sketch_agg("recclass", F.lit(CLASS_BITS)).alias("classes"),
    )
    known = F.col("bucket").isNotNull()
    return by_bucket.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("masses"),
        F.sum(F.when(known, F.col("mass_sum"))).alias("mass_sum"),
        F.min("min_year").alias("min_year"),
        F.max("max_year").alias("max_year"),
        F.hll_union_agg("classes").alias("classes"),
        F.sort_array(F.collect_list(F.when(known, F.struct("bucket", "n")))).alias("buckets"),
    )


def write_kpi_sketches(sketches: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store rows by decade; ``mode="append"`` adds the rows of new records."""
    sketches.write.mode(mode).partitionBy("decade").parquet(path)


def read_kpi_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def filter_sketches(
    sketches: DataFrame, fall_type: str | Iterable[str] | None = None, decade_range: Sequence[int] | None = None
) -> DataFrame:
    """The facets that the store can answer; files of other decades are not read."""
    return filter_decade(filter_fall(sketches, fall_type), decade_range)


def kpi_from_sketches(sketches: DataFrame) -> DataFrame:
    """The row of :func:`facets.kpi_summary`: count, total and mean mass and year span exact, the median within
    ``ERROR`` of the exact one, the number of classes from the merged sketch. No row: null, and no class."""
    merged = sketches.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum("mass_sum").alias("total_mass"),
        F.try_divide(F.sum("mass_sum"), F.sum("masses")).alias("mean_mass"),
        F.min("min_year").alias("min_year"),
        F.max("max_year").alias("max_year"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("classes")), F.lit(0)).alias("n_classes"),
    )
    counts = sketches.select(F.inline("buckets")).groupBy("bucket").agg(F.sum("n").alias("n"))
    ranked = counts.select(
        "bucket",
        F.sum("n").over(Window.partitionBy().orderBy("bucket")).alias("upto"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    middle = [F.min(F.when(F.col("upto") >= rank, F.col("bucket"))) for rank in (F.ceil(F.col("total") / 2), F.floor(F.col("total") / 2) + 1)]
    median = ranked.agg(*[m.alias(name) for m, name in zip(middle, ("low", "high"))])
    value = median.select(((bucket_mass(F.col("low")) + bucket_mass(F.col("high"))) / 2).alias("median_mass"))
    return merged.withColumn("median_mass", value.scalar())
