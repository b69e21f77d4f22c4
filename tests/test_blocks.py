"""Zones met by observations block by block: what leaves a task is one summary for each zone and block."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoscope.operators import blocks, distributions, forecast, nearest, zones


def test_grid_rows_leave_a_block_not_pairs(make_obs, make_locations):
    rng = random.Random(3)
    points = [(rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(2000)]
    zone = make_locations([{"lat": 0.3, "lon": -0.2, "radius": 2.0}]).select("location_id", "lat", "lon", "radius")
    counts = zones.coordinate_counts(make_obs(points))
    rows = blocks.met_in_blocks(counts, zone, forecast._grid_counts(20), "i bigint, counts array<bigint>", reach=F.col("radius") * 4 / 3).collect()
    # Four blocks meet at (0, 0): at most 21 rows from each, however many observations there are.
    assert 21 <= len(rows) <= 4 * 21 and {len(r.counts) for r in rows} == {21}
    total = np.zeros((21, 21), int)
    for r in rows:
        total[r.i] += r.counts
    for i in range(21):
        for j in range(21):
            y, x = -1.7 + i * 0.2, -2.2 + j * 0.2
            n = sum(math.sqrt((p[0] - y) ** 2 + (p[1] - x) ** 2) <= 2.0 / 3 for p in points)
            assert total[i, j] == n


@pytest.mark.parametrize("shape", ["radius", "box"])
def test_crowded_blocks_are_dealt_and_lose_nothing(spark, make_obs, make_locations, shape, monkeypatch):
    monkeypatch.setattr(zones, "CROWDED", 50)
    rng = random.Random(5)
    points = [(rng.uniform(0, 1), rng.uniform(0, 1)) for _ in range(400)] + [(float("nan"), 0.5), (None, 0.5)]
    obs = make_obs([{"reclat": y, "reclong": x} for y, x in points])
    locs = make_locations([{"lat": 0.5, "lon": 0.5, "radius": 0.4}, {"lat": 0.0, "lon": 0.0, "radius": 9.0}, {"lat": None}, {"lat": 50.0}])

    def work(block, asked, at):
        found = blocks.inside(block, *(asked[c][at] for c in ("lat", "lon", "radius")), shape)
        return {"n": np.array([block["n"][found].sum()]), "held": np.array([len(block["n"])])}

    rows = blocks.met_in_blocks(zones.coordinate_counts(obs), locs.select("location_id", "lat", "lon", "radius"), work, "n bigint, held bigint", shape=shape).collect()
    got = {k: sum(r.n for r in rows if r.location_id == k) for k in (0, 1)}
    expected = {r.location_id: r.n for r in zones.zone_summary(zones.coordinate_counts(obs), locs, shape=shape).collect()}
    assert got == expected and max(r.held for r in rows) < 100 and {r.location_id for r in rows} <= {0, 1}


@pytest.mark.parametrize("shape", ["radius", "box"])
def test_a_zone_leaves_a_block_as_few_buckets(make_obs, make_locations, shape):
    rng = random.Random(8)
    # The zone lies in one block; all masses differ.
    points = [{"reclat": rng.uniform(1, 7), "reclong": rng.uniform(1, 7), "mass_g": rng.uniform(1, 1e7)} for _ in range(3000)]
    obs, locs = make_obs(points), make_locations([{"lat": 4.0, "lon": 4.0, "radius": 2.9}])
    seen = []
    plain = distributions.met_in_blocks

    def watched(*args, **kwargs):
        found = plain(*args, **kwargs)
        seen.append(found.count())
        return found

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(distributions, "met_in_blocks", watched)
        median = distributions.zone_median(obs, locs, shape=shape).first().median
        bins = distributions.zone_histogram(obs, locs, "mass_g", shape=shape).collect()
    assert len(seen) == 5 and max(seen) <= 2 * 128  # before, a row for each of thousands of buckets and cells
    in_zone = [p["mass_g"] for p in points if (math.hypot(p["reclat"] - 4, p["reclong"] - 4) if shape == "radius" else max(abs(p["reclat"] - 4), abs(p["reclong"] - 4))) <= 2.9]
    assert median == statistics.median(in_zone) and sum(r.n for r in bins) == len(in_zone)


def test_pairs_of_boxes_and_places_stay_where_they_are(spark, make_obs):
    rng = random.Random(6)
    obs = make_obs([(rng.uniform(0, 2), rng.uniform(0, 2)) for _ in range(50)])
    places = spark.createDataFrame([(k, "X", rng.uniform(0, 2), rng.uniform(0, 2)) for k in range(300)], "place_id long, country string, lat double, lon double")
    near = nearest.nearest_place(obs, places)
    plan = near._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "qid" in line]
    assert sum("parent" in line for line in windows) >= len(nearest.BOX_SIZES) - 1
    known = {r.place_id: (r.lat, r.lon) for r in places.collect()}
    for r in near.collect():
        best = min((math.sqrt((r.reclat - y) ** 2 + (r.reclong - x) ** 2), k) for k, (y, x) in known.items())
        assert (r.distance, r.place_id) == best


def test_measures_of_nothing_known_are_null(make_obs, make_locations):
    obs = make_obs([{"year": None, "recclass": "A"}, {"year": 1900, "recclass": "B"}, {"year": None, "recclass": None}])
    points = zones.coordinate_measures(obs, ["recclass"])
    found = distributions.zone_measured(points, make_locations([{}]), "recclass", zones.MEASURES, "box").collect()
    assert {(r.recclass, r.n, r.year_min, r.years) for r in found} == {("A", 1, None, 0), ("B", 1, 1900, 1), (None, 1, None, 0)}


@pytest.mark.parametrize("shape", ["radius", "box"])
def test_whole_groups_count_as_their_observations(shape, monkeypatch):
    """Groups inside a zone aren't looked at one by one, and what is counted is the same, on the rim and without a number too."""
    rng = np.random.default_rng(7)
    y, x = np.round(rng.uniform(0, 8, 3000), 1), np.round(rng.uniform(0, 8, 3000), 1)
    x[:5], y[5:9] = np.nan, np.nan
    order = np.argsort(y)
    block = {"reclat": y[order], "reclong": x[order], "n": rng.integers(1, 4, 3000)}
    block |= {"cy": np.nan_to_num(np.floor(block["reclat"])).astype(int), "cx": np.nan_to_num(np.floor(block["reclong"])).astype(int)}
    plain, whole = blocks.zone_groups(["cy", "cx"], shape), blocks.zone_compact_groups(["cy", "cx"], shape)
    total = blocks.zone_compact_groups(["cy", "cx"], shape, total=True)
    asked = {"lat": np.round(rng.uniform(-1, 9, 60), 1), "lon": np.round(rng.uniform(-1, 9, 60), 1), "radius": np.round(rng.uniform(0, 6, 60), 1)}
    listed = lambda found: sorted(zip(found["cy"], found["cx"], found["n"]))
    for at in range(60):
        expected = listed(plain(block, asked, at))
        assert listed(whole(block, asked, at)) == expected
        found = total(block, asked, at)
        assert (found["total"][0] if found else 0) == sum(n for *_, n in expected)
    seen, sqrt = [], np.sqrt
    monkeypatch.setattr(blocks.np, "sqrt", lambda v: seen.append(len(v)) or sqrt(v))
    whole(block, {"lat": [4.0], "lon": [4.0], "radius": [3.9]}, 0)
    assert max(seen, default=0) < 2000
