"""Turning dirty source records into clean observations.

The chain is ``coerce_numeric → drop_null_island → drop_missing → fix_nonpositive_mass →
plausible_year → floor_mass → derive_log_mass → fill_year → derive_decade → fill_unknown``.
Everything is a narrow map over the scan, except the smallest positive mass, which is one
scalar subquery (partial minimum per task, one row to the driver's plan, no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscope.functions import number
from geoscope.operators.quantiles import exact_median

EARLIEST_YEAR = 1000
SMALLEST_MASS = 1.0


def coerce_numeric(raw: DataFrame) -> DataFrame:
    """mass_raw → mass_g and year_raw → year_num; text that is no number becomes null."""
    return raw.select(
        "id",
        "name",
        "recclass",
        "fall",
        "reclat",
        "reclong",
        number("mass_raw").alias("mass_g"),
        number("year_raw").alias("year_num"),
    )


def _null_island():
    return F.coalesce((F.col("reclat") == 0) & (F.col("reclong") == 0), F.lit(False))


def drop_null_island(obs: DataFrame) -> DataFrame:
    return obs.filter(~_null_island())


def _missing(df: DataFrame, name: str):
    """Null, or a floating column's NaN."""
    floating = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return (F.col(name).isNull() | F.isnan(name)) if floating else F.col(name).isNull()


def _any_missing(obs: DataFrame):
    return _missing(obs, "reclat") | _missing(obs, "reclong") | _missing(obs, "mass_g")


def drop_missing(obs: DataFrame) -> DataFrame:
    return obs.filter(~_any_missing(obs))


def fix_nonpositive_mass(obs: DataFrame) -> DataFrame:
    """Masses at or below zero become the smallest positive mass of the frame."""
    smallest = obs.agg(F.min(F.when(F.col("mass_g") > 0, F.col("mass_g")))).scalar()
    return obs.withColumn("mass_g", F.when(F.col("mass_g") <= 0, smallest).otherwise(F.col("mass_g")))


def plausible_year(obs: DataFrame, as_of_year: int) -> DataFrame:
    year = F.col("year_num")
    return obs.filter(year.isNull() | year.between(float(EARLIEST_YEAR), float(as_of_year)))


def impute_median_mass(obs: DataFrame) -> DataFrame:
    """Null masses become the exact median mass. Not part of ``clean_obs``: there, records
    without a mass are already gone."""
    median = exact_median(obs.select("mass_g"), [], "mass_g", few_keys=True).select("median").scalar()
    return obs.withColumn("mass_g", F.coalesce("mass_g", median))


def floor_mass(obs: DataFrame) -> DataFrame:
    """Masses below 1 g become 1 g; a missing mass stays missing."""
    mass = F.col("mass_g")
    return obs.withColumn("mass_g", F.when(mass < SMALLEST_MASS, F.lit(SMALLEST_MASS)).otherwise(mass))


def derive_log_mass(obs: DataFrame) -> DataFrame:
    return obs.withColumn("adjusted_mass", F.col("mass_g")).withColumn("log_mass", F.log10("mass_g"))


def fill_year(obs: DataFrame) -> DataFrame:
    """Missing year → 0, fractions cut. A year beyond the integers is unknown, so 0 too."""
    return obs.withColumn("year", F.coalesce(F.col("year_num").try_cast("int"), F.lit(0))).drop("year_num")


def derive_decade(obs: DataFrame) -> DataFrame:
    return obs.withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("int"))


def fill_unknown(obs: DataFrame) -> DataFrame:
    return obs.fillna("Unknown", subset=["fall", "recclass"])


def clean_obs(raw: DataFrame, as_of_year: int) -> DataFrame:
    """The whole cleaning chain; ``as_of_year`` bounds plausible years (never the wall clock)."""
    located = drop_missing(drop_null_island(coerce_numeric(raw)))
    dated = plausible_year(fix_nonpositive_mass(located), as_of_year)
    obs = fill_unknown(derive_decade(fill_year(derive_log_mass(floor_mass(dated)))))
    return obs.select(
        "id", "name", "recclass", "fall", "reclat", "reclong",
        "mass_g", "adjusted_mass", "log_mass", "year", "decade",
    )


def clean_report(raw: DataFrame, as_of_year: int) -> DataFrame:
    """What each cleaning step did, from one pass of conditional counts."""
    num = coerce_numeric(raw)
    island = _null_island()
    missing = ~island & _any_missing(num)
    located = ~island & ~missing
    year = F.col("year_num")
    dated = located & (year.isNull() | year.between(float(EARLIEST_YEAR), float(as_of_year)))
    mass = F.col("mass_g")
    return num.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(island).alias("null_island_rows"),
        F.count_if(missing).alias("missing_value_rows"),
        F.count_if(located & (mass <= 0)).alias("corrected_masses"),
        F.min(F.when(located & (mass > 0), mass)).alias("min_valid_mass"),
        F.count_if(located & ~dated).alias("implausible_year_rows"),
        F.count_if(dated).alias("rows_out"),
        F.min(F.when(dated, mass)).alias("_min_kept"),
    ).select(
        "rows_in", "null_island_rows", "missing_value_rows", "corrected_masses", "min_valid_mass",
        "implausible_year_rows", "rows_out",
        F.greatest(
            F.when(F.col("_min_kept") <= 0, F.col("min_valid_mass")).otherwise(F.col("_min_kept")),
            F.lit(SMALLEST_MASS),
        ).alias("min_mass_after"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: its type and its number of nulls, NaN included (one aggregate, then unpivoted)."""
    counts = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    entries = [
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.col(name).alias("nulls"))
        for name, kind in df.dtypes
    ]
    return counts.select(F.inline(F.array(*entries)))


def fill_by_type(df: DataFrame, text_fill: str = "Non spécifié", coerce_text: bool = False) -> DataFrame:
    """Null text → ``text_fill``, null numbers → 0.

    ``coerce_text`` also turns a text column fully numeric (non-numbers → 0) as soon as one
    of its values is a number; this needs one aggregate over the data to decide the types.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    filled = df.fillna(text_fill, subset=text).fillna(0, subset=numeric)
    if not coerce_text or not text:
        return filled
    found = df.agg(*[F.max(number(c).isNotNull()).alias(c) for c in text]).first()
    turned = {c: F.coalesce(number(c), F.lit(0.0)) for c in text if found[c]}
    return filled.withColumns(turned) if turned else filled
