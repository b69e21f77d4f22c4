import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


OBS = "id long, name string, recclass string, fall string, reclat double, reclong double, mass_g double, year int"


@pytest.fixture
def make_obs(spark):
    """Observations from (lat, lon) tuples or dicts; anything left out gets a default."""

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            if not isinstance(row, dict):
                row = {"reclat": float(row[0]), "reclong": float(row[1])}
            full = {
                "id": i, "name": f"s{i}", "recclass": "L6", "fall": "Found",
                "reclat": 0.0, "reclong": 0.0, "mass_g": 10.0, "year": 1900,
            }
            full.update(row)
            out.append(tuple(full.values()))
        return spark.createDataFrame(out, OBS).selectExpr("*", "cast(floor(year / 10) * 10 as int) as decade")

    return build


@pytest.fixture
def make_locations(spark):
    def build(rows):
        schema = (
            "location_id long, lat double, lon double, radius double, horizon int, detection string, "
            "env_factor double, hist_weight double, complexity int"
        )
        out = []
        for i, row in enumerate(rows):
            full = {
                "location_id": i, "lat": 0.0, "lon": 0.0, "radius": 2.5, "horizon": 10, "detection": "all",
                "env_factor": 0.5, "hist_weight": 0.7, "complexity": 5,
            }
            full.update(row)
            out.append(tuple(full.values()))
        return spark.createDataFrame(out, schema)

    return build
