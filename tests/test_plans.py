"""What reaches the files, and how zones are joined."""

from conftest import SMALL

import __spark_entry__ as entry
from geoscope.operators import zones
from geoscope.plans import derived, staging


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_files(spark):
    text = plan(entry.queries()["filter_obs"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(mass_g)" in text and "GreaterThanOrEqual(mass_g" in text
    assert "PartitionFilters: [isnotnull(decade" in text


def test_only_needed_columns_are_read(spark):
    text = plan(entry.queries()["top_classes"](spark, SMALL))
    assert "ReadSchema: struct<recclass:string>" in text


def test_year_filters_skip_decades(spark):
    text = plan(entry.queries()["year_trend"](spark, SMALL))
    assert "PartitionFilters: [isnotnull(decade" in text


def test_zone_cells_are_never_broadcast(spark, monkeypatch):
    """Unless they were counted: beyond the bound they are shuffled."""
    located, zones_ = staging.obs(spark, SMALL), derived.parameters(spark, SMALL)
    assert "BroadcastHashJoin [cy" in plan(zones.within_radius(located, zones_))
    monkeypatch.setattr(zones, "FEW_CELLS", 10)
    monkeypatch.setattr(zones.bounded, "__defaults__", (10,))
    assert "SortMergeJoin [cy" in plan(zones.within_radius(located, zones_))
    assert "SortMergeJoin [level" in plan(zones.zone_summary(zones.coordinate_counts(located), zones_))


def test_staging_uses_the_shared_folder(spark):
    staged = staging.obs(spark, SMALL)
    assert staging.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(staging.shared_folder(spark) in f for f in staged.inputFiles())
