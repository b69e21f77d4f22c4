"""Space-order keys and store, covers of zones, rings and crowded cells."""

import random

import pytest
from pyspark.sql import functions as F

from geoscope.functions.space import place_of, place_runs
from geoscope.operators import zones
from geoscope.plans import staging
from geoscope.sources import read_obs_in_place, write_obs_in_place

MEDIUM = "/root/testdata/sf0.1"


def rows_read(df):
    """Rows that the scans of a finished query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec" and "place" in node.schema().simpleString():
                found += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found


def test_runs_hold_the_keys_of_their_boxes(spark):
    rng = random.Random(1)
    points = [(rng.uniform(-95, 95), rng.uniform(-190, 190)) for _ in range(3000)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]
    keys = [r.k for r in spark.createDataFrame(points, "reclat double, reclong double").select(place_of().alias("k")).collect()]
    for _ in range(60):
        lat, lon, r = rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((0.01, 1.0, 7.5, 60.0))
        for most in (1, 4, 32):
            runs = place_runs([(lat - r, lat + r, lon - r, lon + r)], most)
            assert len(runs) <= most
            for (y, x), key in zip(points, keys):
                if lat - r <= y <= lat + r and lon - r <= x <= lon + r:
                    assert any(a <= key <= b for a, b in runs)
    assert spark.createDataFrame([(None, 1.0)], "reclat double, reclong double").select(place_of()).first()[0] is None


@pytest.mark.parametrize("shape", ["radius", "box"])
def test_cover_is_exact_and_grows_with_the_radius(spark, shape):
    sizes = zones.cover_sizes(0.5)
    counts = {}
    for r in (1.0, 10.0, 90.0):
        zone = spark.createDataFrame([(1, 10.3, 20.7, r)], "location_id long, lat double, lon double, radius double")
        cells = zones.zone_cover(zone, 0.5, shape).collect()
        counts[r] = len(cells)
        fine = {(c.cy, c.cx) for c in zones.touched_cells(zone, 0.5, shape).collect()}
        covered = []
        for c in cells:
            k = 1 if c.level == zones.RIM else int(sizes[c.level] / 0.5)
            covered += [(c.cy * k + i, c.cx * k + j) for i in range(k) for j in range(k)]
        assert len(covered) == len(set(covered)) and set(covered) == fine
    assert counts[10.0] <= 60 * 10 and counts[90.0] <= 60 * 90


def test_one_location_reads_few_pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("places")) + "/obs"
    write_obs_in_place(staging.obs(spark, MEDIUM), path)
    stored = read_obs_in_place(spark, path)
    total = stored.count()
    for lat, lon in ((10.3, 20.7), (-45.0, 100.0), (0.0, 0.0)):
        one = spark.createDataFrame([(1, lat, lon, 2.5)], "location_id long, lat double, lon double, radius double")
        found = zones.within_radius(stored, one)
        rows = found.collect()
        assert 0 < rows_read(found) < total * 0.05
        distance = F.sqrt((F.col("reclat") - lat) * (F.col("reclat") - lat) + (F.col("reclong") - lon) * (F.col("reclong") - lon))
        assert {r.id for r in rows} == {r.id for r in stored.filter(distance <= 2.5).collect()}
    assert stored.drop("place").exceptAll(staging.obs(spark, MEDIUM)).count() == 0


def test_many_zones_keep_only_touched_degrees(spark, make_obs, make_locations):
    rng = random.Random(4)
    obs = make_obs([(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(3000)] + [(91.0, 0.0), (0.0, 200.0)])
    some = [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((0.1, 1.0, 9.0))) for _ in range(100)] + [(90.5, 0.0, 1.0)]
    locs = make_locations([{"lat": a, "lon": o, "radius": r} for a, o, r in some])
    left = {r.id for r in zones.near(obs, locs).collect()}
    inside = {r.id for r in zones.within_box(obs, locs).select("id").distinct().collect()}
    assert inside <= left and len(left) < 3000
    assert zones.near(obs, locs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0.125, 0.5, 4.0])
def test_crowded_cells_are_dealt_evenly(spark, make_obs, make_locations, size, monkeypatch):
    """A third of all different coordinates in one cell: no salt has more than twice the rows of the middle one,
    and the pairs stay the same."""
    rng = random.Random(9)
    crowd = [(10 + rng.random() / 16, 20 + rng.random() / 16) for _ in range(1500)]
    rest = [(rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(3000)]
    obs = make_obs(crowd + rest)
    locs = make_locations([{"lat": 10.0, "lon": 20.0, "radius": 0.05}, {"lat": 10.1, "lon": 20.1, "radius": 3.0}, {"radius": 40.0}])
    points = zones.with_cell(obs, size)
    drawn, listed = zones.dealt(points, zones.touched_cells(locs, size, "radius"), size, most=100)
    per_task = sorted(r["count"] for r in drawn.filter("reclat between 10 and 10.0625").groupBy("cy", "cx", "salt").count().collect())
    assert len(per_task) >= 15 and per_task[-1] <= 2 * per_task[len(per_task) // 2]
    assert drawn.filter("salt > 0 and reclat < 0").count() == 0
    expected = {(r.location_id, r.id) for r in zones.within_radius(obs, locs).collect()}
    monkeypatch.setattr(zones, "CROWDED", 100)
    monkeypatch.setattr(zones.bounded, "__defaults__", (0,))
    assert {(r.location_id, r.id) for r in zones.within_zone(obs, locs, "radius", size).collect()} == expected


def test_rings_share_a_join(spark, make_obs, make_locations):
    rng = random.Random(12)
    obs = make_obs([(rng.uniform(-20, 20), rng.uniform(-20, 20)) for _ in range(800)])
    locs = make_locations([{"lat": float(i), "lon": 2.0 * i, "radius": 1.5 + i} for i in range(4)])
    counts = zones.coordinate_counts(obs)
    both = zones.zone_summary(counts, zones.rings(locs, (1.0, 3.0)), ["location_id", "ring"])
    got = {(r.location_id, r.ring): r.n for r in both.collect()}
    for ring in (1.0, 3.0):
        alone = zones.zone_summary(counts, locs.withColumn("radius", F.col("radius") * ring)).collect()
        assert {r.location_id: r.n for r in alone} == {k: n for (k, f), n in got.items() if f == ring}
