"""The cleaned catalogue, written once per session and then read by every query.

Cleaning is a job of its own: queries read a columnar, decade-partitioned table, so column
pruning, pushed filters and partition pruning reach the files, and no query repeats the
cleaning. The table lies in the shared folder named by ``spark.checkpoint.dir``; being files,
it survives the loss of any executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoscope.operators import sketches
from geoscope.plans import derived
from geoscope.sources import read_country_names, read_gazetteer, read_obs, read_obs_in_place, write_obs, write_obs_in_place

_staged: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder in the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        path = new_path(spark, name)
        write(path)
        _staged[key] = path
    return _staged[key]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_obs(spark, _once(spark, sf_dir, "obs", lambda path: write_obs(derived.obs(spark, sf_dir), path)))


def obs_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue in space order, for searches around few locations."""
    path = _once(spark, sf_dir, "obs_in_place", lambda path: write_obs_in_place(obs(spark, sf_dir), path))
    return read_obs_in_place(spark, path)


def kpi_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's key figures as sketches by decade and fall type."""

    def write(path: str) -> None:
        sketches.write_kpi_sketches(sketches.kpi_sketches(obs(spark, sf_dir)), path)

    return sketches.read_kpi_sketches(spark, _once(spark, sf_dir, "kpi_sketches", write))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places as a Parquet gazetteer that its reader reads."""
    return read_gazetteer(spark, _once(spark, sf_dir, "gazetteer", derived.gazetteer(spark, sf_dir).write.parquet))


def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country names as a headed CSV that its reader reads."""
    names = derived.country_names(spark, sf_dir)
    return read_country_names(spark, _once(spark, sf_dir, "country_names", lambda path: names.write.csv(path, header=True)))
