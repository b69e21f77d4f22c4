"""Places with a country, and the country name / ISO3 lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GAZETTEER_SCHEMA = T.StructType(
    [
        T.StructField("place_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

COUNTRY_SCHEMA = T.StructType(
    [
        T.StructField("country", T.StringType()),
        T.StructField("country_name", T.StringType()),
        T.StructField("iso_alpha", T.StringType()),
    ]
)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GAZETTEER_SCHEMA).parquet(path)


def read_country_names(spark: SparkSession, path: str) -> DataFrame:
    """Country code → display name and ISO3 code (headed CSV)."""
    return spark.read.schema(COUNTRY_SCHEMA).csv(path, header=True)
