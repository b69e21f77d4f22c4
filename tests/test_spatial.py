"""Zone joins, zone distributions and nearest neighbours against brute force."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from geoscope.operators import globe, nearest, zones
from geoscope.operators.quantiles import exact_median


def distance(a, b):
    dy, dx = a[0] - b[0], a[1] - b[1]
    return (dy * dy + dx * dx) ** 0.5


@pytest.fixture(scope="module")
def cloud():
    """A third of the records on one spot, a third crowded into one cell, the rest anywhere."""
    rng = random.Random(7)
    spot = [(10.25, 20.5)] * 60
    crowd = [(round(10 + rng.random() / 4, 3), round(20 + rng.random() / 4, 3)) for _ in range(60)]
    far = [(round(rng.uniform(-80, 80), 2), round(rng.uniform(-180, 180), 2)) for _ in range(60)]
    return spot + crowd + far


@pytest.fixture(scope="module")
def centres():
    rng = random.Random(11)
    near = [(10.0 + i / 8, 20.0 + i / 4, r) for i, r in enumerate((0.25, 0.5, 1.0, 2.5, 10.0))]
    return near + [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((0.5, 2.5, 10.0))) for _ in range(20)]


def zone_rows(make_locations, centres):
    return make_locations([{"lat": float(a), "lon": float(o), "radius": float(r)} for a, o, r in centres])


def members(cloud, centre, shape):
    lat, lon, r = centre
    if shape == "box":
        return [i for i, p in enumerate(cloud) if lat - r <= p[0] <= lat + r and lon - r <= p[1] <= lon + r]
    return [i for i, p in enumerate(cloud) if distance(p, centre) <= r]


@pytest.mark.parametrize("shape", ["radius", "box"])
@pytest.mark.parametrize("cell", [0.125, 0.5, 4.0])
def test_pairs_and_counts_equal_brute_force(make_obs, make_locations, cloud, centres, shape, cell):
    obs, locs = make_obs(cloud), zone_rows(make_locations, centres)
    pairs = {(r.location_id, r.id) for r in zones.within_zone(obs, locs, shape, cell).collect()}
    expected = {(k, i) for k, c in enumerate(centres) for i in members(cloud, c, shape)}
    assert pairs == expected
    counts = zones.zone_summary(zones.coordinate_counts(obs), locs, shape=shape, cell=cell).collect()
    assert {r.location_id: r.n for r in counts} == {
        k: len(members(cloud, c, shape)) for k, c in enumerate(centres) if members(cloud, c, shape)
    }


@pytest.mark.parametrize("search", [zones.within_radius, zones.within_box, globe.within_radius])
def test_a_crowd_of_pairs_is_dealt_over_tasks(make_obs, make_locations, monkeypatch, search):
    """400 records and 100 zones in one cell: few rows, yet no task makes most of their pairs."""
    monkeypatch.setattr(zones, "bounded", lambda cells: False)
    monkeypatch.setattr(zones, "PAIRS", 5_000, raising=False)
    rng = random.Random(4)
    obs = make_obs([(10 + rng.random() * 0.4, 20 + rng.random() * 0.4) for _ in range(400)])
    locs = make_locations([{"lat": 10 + rng.random() * 0.4, "lon": 20 + rng.random() * 0.4, "radius": 1.5} for _ in range(100)])
    found = search(obs, locs).select("location_id", "id", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 40_000 and len({(r.location_id, r.id) for r in found}) == 40_000
    tasks = [r.task for r in found]
    assert max(tasks.count(t) for t in set(tasks)) <= 20_000


def test_edge_of_the_zone_is_inside(make_obs, make_locations):
    obs = make_obs([(0.0, 2.5), (0.0, 2.5000001), (1.5, 2.0), (-2.5, 0.0)])
    ids = {r.id for r in zones.within_radius(obs, make_locations([{}])).collect()}
    assert ids == {0, 2, 3}


def test_many_locations_equal_single_ones(make_obs, make_locations, cloud, centres):
    obs = make_obs(cloud)
    together = zones.zone_summary(zones.coordinate_counts(obs), zone_rows(make_locations, centres))
    n = {r.location_id: r.n for r in together.collect()}
    for k in (0, 3, 4):
        alone = zones.zone_summary(zones.coordinate_counts(obs), zone_rows(make_locations, centres[k : k + 1]))
        assert alone.first().n == n[k]


def test_points_without_coordinates_are_nowhere(make_obs, make_locations):
    obs = make_obs([{"reclat": None}, {"reclong": None}, {}])
    assert zones.zone_summary(zones.coordinate_counts(obs), make_locations([{}])).first().n == 1
    assert nearest.nearest_distance(obs, make_locations([{"lat": 3.0}])).first().d_min == 3.0


@pytest.mark.parametrize("shape", ["radius", "box"])
def test_zone_medians_and_histograms(make_obs, make_locations, cloud, centres, shape):
    rng = random.Random(3)
    mass = [rng.choice((1.0, 2.0, 50.5, 1e6 + rng.random(), rng.uniform(1, 1e7))) for _ in cloud]
    obs = make_obs([{"reclat": p[0], "reclong": p[1], "mass_g": m} for p, m in zip(cloud, mass)])
    locs = zone_rows(make_locations, centres)
    got = {r.location_id: r.median for r in zones.zone_median(obs, locs, shape=shape).collect()}
    inside = {k: [mass[i] for i in members(cloud, c, shape)] for k, c in enumerate(centres)}
    assert got == {k: statistics.median(v) for k, v in inside.items() if v}

    bins = zones.zone_histogram(obs, locs, "mass_g", bins=7, min_rows=5, shape=shape).collect()
    counted = {}
    for r in bins:
        counted[r.location_id, r.bin] = r.n
    expected = {}
    for k, values in inside.items():
        if len(values) < 5:
            continue
        lo, hi = min(values), max(values)
        for v in values:
            b = min(int((v - lo) / (hi - lo) * 7), 6) if hi > lo else 0
            expected[k, b] = expected.get((k, b), 0) + 1
    assert counted == expected


def test_exact_median_by_group_and_overall(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice((3.0, 3.0000000001, 1e-9, -5.0, 0.0, rng.gauss(0, 1e6)))) for _ in range(501)]
    rows += [("pair", 1.0), ("pair", 2.0), ("one", 4.25), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    for few in (True, False):
        got = {r.k: r.median for r in exact_median(df, ["k"], "v", few_keys=few).collect()}
        assert got == {k: statistics.median(v) for k, v in groups.items()}
    everything = [v for _, v in rows if v is not None]
    assert exact_median(df, [], "v").first().median == statistics.median(everything)
    assert exact_median(df.filter("false"), [], "v").first().median is None
    assert exact_median(df.filter("false"), ["k"], "v").count() == 0


def test_nearest_distance_near_and_far(make_obs, make_locations, cloud, centres):
    places = [*centres, (89.0, 179.0, 1.0), (-90.0, -180.0, 1.0), (10.25, 20.5, 1.0)]
    got = nearest.nearest_distance(make_obs(cloud), zone_rows(make_locations, places)).collect()
    assert {r.location_id: r.d_min for r in got} == {
        k: min(distance(p, c) for p in cloud) for k, c in enumerate(places)
    }


def test_one_record_on_the_other_side_and_records_off_the_globe(make_obs, make_locations):
    alone = nearest.nearest_distance(make_obs([(80.0, 179.5)]), make_locations([{"lat": -80.0, "lon": -179.0}]))
    assert alone.first().d_min == distance((80.0, 179.5), (-80.0, -179.0))
    off = nearest.nearest_distance(make_obs([(10.0, 354.5), (500.0, 0.0)]), make_locations([{"lat": 10.0, "lon": 170.0}]))
    assert off.first().d_min == 184.5
    assert nearest.nearest_distance(make_obs([(0, 0)]).filter("false"), make_locations([{}])).count() == 0


def test_crowded_cell_meets_few_pairs(spark):
    """100,000 coordinates inside one cell of 1/64 degree, and 1,000 queries there."""
    rng = random.Random(8)
    size = nearest.LEVELS[-1]
    crowd = [(10 + rng.random() * size, 20 + rng.random() * size) for _ in range(100_000)]
    asked = [(i, 10 + rng.random() * size, 20 + rng.random() * size) for i in range(1000)]
    points = spark.createDataFrame(crowd, "reclat double, reclong double").repartition(8)
    queries = spark.createDataFrame([(i, a, a, o, o) for i, a, o in asked], "qid long, q_south double, q_north double, q_west double, q_east double")
    per_query = nearest.nearest_pairs(points, queries).groupBy("qid").count()
    most = per_query.agg(F.max("count"), F.count("*")).first()
    assert most[1] == 1000 and most[0] <= 8 * nearest.LEAF
    locations = spark.createDataFrame(asked[:40], "location_id long, lat double, lon double")
    got = {r.location_id: r.d_min for r in nearest.nearest_distance(points, locations).collect()}
    assert got == {i: min(distance(p, (a, o)) for p in crowd) for i, a, o in asked[:40]}


def test_nearest_place_with_ties(make_obs, spark, cloud):
    rng = random.Random(2)
    gazetteer = [(i, f"c{i % 3}", round(rng.uniform(-80, 80)), round(rng.uniform(-170, 170))) for i in range(40)]
    gazetteer += [(100, "a", 10.0, 22.0), (101, "b", 10.0, 22.0), (90, "z", 10.0, 19.0)]
    table = spark.createDataFrame([(i, c, float(a), float(o)) for i, c, a, o in gazetteer], "place_id long, country string, lat double, lon double")
    points = [*cloud, (10.0, 20.5), (0.0, 0.0)]
    got = {(r.reclat, r.reclong): (r.place_id, r.n) for r in nearest.nearest_place(make_obs(points), table).collect()}
    for p in set(points):
        best = min((distance(p, (a, o)), i) for i, _, a, o in gazetteer)
        assert got[p] == (best[1], points.count(p))
    names = spark.createDataFrame([("c0", "Zero", "ZER")], "country string, country_name string, iso_alpha string")
    counts = nearest.country_counts(make_obs(points), table, names)
    assert counts.agg(F.sum("n")).first()[0] == len(points) - 1
    assert {r.iso_alpha for r in counts.filter("country = 'c0'").collect()} <= {"ZER"}
