"""Reading the dirty source catalogue, and storing and re-reading cleaned observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoscope.functions import number
from geoscope.functions.space import PLACE, place_of

# Dirty columns stay text: cleaning decides what is a number, the reader never does.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("recclass", T.StringType()),
        T.StructField("mass_raw", T.StringType()),
        T.StructField("fall", T.StringType()),
        T.StructField("year_raw", T.StringType()),
        T.StructField("reclat", T.DoubleType()),
        T.StructField("reclong", T.DoubleType()),
    ]
)

# Header names of the public CSV, by raw column name.
CSV_HEADER = {"mass (g)": "mass_raw", "year": "year_raw"}

OBS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("recclass", T.StringType()),
        T.StructField("fall", T.StringType()),
        T.StructField("reclat", T.DoubleType()),
        T.StructField("reclong", T.DoubleType()),
        T.StructField("mass_g", T.DoubleType()),
        T.StructField("adjusted_mass", T.DoubleType()),
        T.StructField("log_mass", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("decade", T.IntegerType()),
    ]
)


# Words that stand for a missing value in any column of a CSV.
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read a headed CSV by column *name*; extra columns are ignored, missing ones are null.

    Quoted fields may hold commas and doubled quotes, and line breaks with ``multi_line`` (such files
    are not split between tasks). Every value is read as text (one pass, no inference); words that
    stand for a missing value become null, then the id is try-cast and coordinates are kept where they
    are written as numbers, so one malformed field never drops a record.
    """
    table = spark.read.csv(path, header=True, mode="PERMISSIVE", quote='"', escape='"', multiLine=multi_line)
    table = table.withColumnsRenamed(CSV_HEADER)
    text = table.select(*[F.when(~F.col(f"`{c}`").isin(NULL_WORDS), F.col(f"`{c}`")).alias(c) for c in table.columns])

    def value(f: T.StructField):
        if f.name not in table.columns:
            return F.lit(None).cast(f.dataType)
        return number(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name).try_cast(f.dataType)

    return text.select(*[value(f).alias(f.name) for f in RAW_SCHEMA.fields])


def write_raw_csv(raw: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store raw records as a headed CSV that :func:`read_raw_csv` reads back."""
    raw.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).parquet(path)


def write_obs(obs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store cleaned observations as Parquet split by decade, so decade filters prune files.

    REBALANCE groups rows by decade for few files, and lets AQE cut a heavy decade into
    several tasks at the advisory size instead of sending it through one.
    """
    obs.hint("rebalance", F.col("decade")).write.mode(mode).partitionBy("decade").parquet(path)


def read_obs(spark: SparkSession, path: str) -> DataFrame:
    """Re-read stored observations; the schema is given, so no file is opened to infer it."""
    return spark.read.schema(OBS_SCHEMA).parquet(path).select(*OBS_SCHEMA.fieldNames())


#: Rows of a page, whose least and largest values the files list, in a store in space order.
PAGE_ROWS = 1000


def write_obs_in_place(obs: DataFrame, path: str, mode: str = "errorifexists", page_rows: int = PAGE_ROWS) -> None:
    """Store cleaned observations in space order, with their key ``place``, for searches around few locations.

    Rows are ranged and sorted by the key, so a page of a file covers a small area, and a filter on
    coordinates or keys reads only pages whose statistics allow a match. Records without coordinates come first;
    those of one spot are dealt by id, as a spot may hold a third of all."""
    keyed = obs.withColumn(PLACE, place_of())
    ordered = keyed.repartitionByRange(PLACE, "id").sortWithinPartitions(PLACE, "id")
    ordered.write.mode(mode).option("parquet.page.row.count.limit", str(page_rows)).parquet(path)


def read_obs_in_place(spark: SparkSession, path: str) -> DataFrame:
    """Re-read a store in space order: the columns of observations, and ``place``."""
    return spark.read.schema(T.StructType([*OBS_SCHEMA.fields, T.StructField(PLACE, T.LongType())])).parquet(path)


def write_filtered_json(obs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a filtered view as JSON lines (text interchange; Parquet is the fast path)."""
    obs.write.mode(mode).json(path)


def read_filtered_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBS_SCHEMA).json(path)
