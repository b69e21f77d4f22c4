"""Tables written to the folder that the cluster's machines share.

``spark.checkpoint.dir`` names it. Where that is unset, as in tests, the warehouse serves. Written
tables cut lineage and survive the loss of any executor; they go when the application ends, or
earlier by :func:`drop`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    return path


def drop(spark: SparkSession, path: str) -> None:
    system, place = _file_system(spark, path)
    system.delete(place, True)


def bounded_batches(spark: SparkSession, rows: int = 4000) -> None:
    """Lets Spark send Python workers at most so many rows at a time, as a row can be a long text (Spark
    bounds a batch's bytes by itself)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table of their own, and where it lies."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
