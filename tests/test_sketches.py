"""Key figures from stored sketches against the exact ones."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from geoscope.operators import facets, filters, sketches
from geoscope.plans import staging


@pytest.fixture
def records(make_obs):
    rng = random.Random(4)
    masses = [rng.choice((1.0, 0.0, -3.0, 1e-12, 1e9, rng.uniform(1, 100), 10 ** rng.uniform(-3, 8))) for _ in range(900)]
    rows = [
        {"mass_g": m, "recclass": f"c{rng.randrange(60)}", "fall": rng.choice(("Fell", "Found")), "year": rng.choice((0, 1955, 1960, 1961, 2001))}
        for m in masses
    ]
    return make_obs(rows + [{"mass_g": None, "year": 1960}, {"mass_g": 7.5, "recclass": None, "fall": None, "year": 1960}])


def agree(sketched, exact):
    assert (sketched.n, sketched.min_year, sketched.max_year) == (exact.n, exact.min_year, exact.max_year)
    assert sketched.total_mass == pytest.approx(exact.total_mass) and sketched.mean_mass == pytest.approx(exact.mean_mass)
    assert abs(sketched.n_classes - exact.n_classes) <= 0.05 * exact.n_classes
    assert abs(sketched.median_mass - exact.median_mass) <= sketches.ERROR * abs(exact.median_mass) + 1e-12


@pytest.mark.parametrize("fall_type, decades", [(None, None), ("Fell", None), (None, (1950, 1960)), (["Found"], (2000, 2000)), ("Fell", (0, 0))])
def test_figures_within_their_bounds(records, fall_type, decades):
    store = sketches.kpi_sketches(records)
    found = sketches.kpi_from_sketches(sketches.filter_sketches(store, fall_type, decades)).first()
    kept = filters.filter_decade(filters.filter_fall(records, fall_type), decades)
    exact = facets.kpi_summary(kept).first()
    assert exact.median_mass > 0
    agree(found, exact)


def test_every_mass_is_within_the_error_of_its_bucket(spark):
    rng = random.Random(9)
    masses = [10 ** rng.uniform(-12, 12) for _ in range(5000)] + [sketches.GROWTH**k for k in range(-40, 40)]
    df = spark.createDataFrame([(m,) for m in masses], "m double")
    off = F.abs(sketches.bucket_mass(sketches.mass_bucket(F.col("m"))) - F.col("m")) / F.col("m")
    assert df.agg(F.max(off)).first()[0] <= sketches.ERROR * (1 + 1e-9)


def test_new_records_are_appended(records, spark, tmp_path):
    path = str(tmp_path / "kpi")
    old = F.col("id") % 3 == 0
    sketches.write_kpi_sketches(sketches.kpi_sketches(records.filter(old)), path)
    sketches.write_kpi_sketches(sketches.kpi_sketches(records.filter(~old)), path, mode="append")
    grown = sketches.kpi_from_sketches(sketches.read_kpi_sketches(spark, path)).first()
    assert grown.n == 902
    whole = sketches.kpi_from_sketches(sketches.kpi_sketches(records)).first()
    assert grown.total_mass == pytest.approx(whole.total_mass)
    assert (grown.median_mass, grown.n_classes, grown.min_year) == (whole.median_mass, whole.n_classes, whole.min_year)


def test_nothing_gives_no_figures(records):
    found = sketches.kpi_from_sketches(sketches.kpi_sketches(records.limit(0))).first()
    assert (found.n, found.n_classes, found.total_mass, found.median_mass) == (0, 0, None, None)


def test_the_catalogue_is_not_read_again(spark):
    store = staging.kpi_sketches(spark, SMALL)
    found = sketches.kpi_from_sketches(sketches.filter_sketches(store, "Fell", (1900, 1950)))
    assert all("kpi_sketches" in f for f in found.inputFiles())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(decade" in plan
    assert store.count() < staging.obs(spark, SMALL).count()
