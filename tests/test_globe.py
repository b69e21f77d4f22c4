"""Great-circle zones and nearest searches against brute force, with cases over ±180° and the poles."""

import math
import random

import pytest

from geoscope.operators import globe


def arc(a, b):
    dy, dx = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    h = math.sin(dy) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dx) ** 2
    return math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))


@pytest.fixture(scope="module")
def cloud():
    """Anywhere, crowded along ±180°, at both poles, and written beyond ±180°."""
    rng = random.Random(5)
    anywhere = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(300)]
    seam = [(rng.uniform(-30, 30), rng.choice((-1, 1)) * (180 - rng.random() * 3)) for _ in range(150)]
    poles = [(rng.choice((-1, 1)) * (90 - rng.random() ** 2 * 8), rng.uniform(-180, 180)) for _ in range(200)]
    return anywhere + seam + poles + [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (10.0, 354.5), (10.0, -186.0), (0.0, 0.0)]


@pytest.fixture(scope="module")
def centres():
    rng = random.Random(6)
    fixed = [(0.0, 179.9, 2.5), (0.0, -180.0, 1.0), (89.0, 10.0, 2.5), (-90.0, 0.0, 5.0), (90.0, 33.0, 0.0), (87.5, -170.0, 2.5), (10.0, -5.5, 0.5)]
    fixed += [(10.0, 174.0, 0.001), (0.0, 0.0, 89.9), (20.0, 50.0, 95.0), (-80.0, 179.0, 120.0), (45.0, 0.0, 180.0), (10.0, 534.5, 3.0)]
    return fixed + [(rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice((0.5, 2.5, 10.0, 40.0))) for _ in range(25)]


def expected_pairs(cloud, centres):
    return {(k, i) for k, c in enumerate(centres) for i, p in enumerate(cloud) if arc(p, c) <= c[2]}


def rows(make_locations, centres):
    return make_locations([{"lat": a, "lon": o, "radius": r} for a, o, r in centres])


@pytest.mark.parametrize("cell", [0.5, 4.0])
def test_zones_equal_brute_force(make_obs, make_locations, cloud, centres, cell):
    obs, zones = make_obs(cloud), rows(make_locations, centres)
    found = globe.within_radius(obs, zones, cell=cell).collect()
    expected = expected_pairs(cloud, centres)
    assert len(found) == len(expected) and {(r.location_id, r.id) for r in found} == expected
    assert all(abs(r.distance - arc(cloud[r.id], centres[r.location_id])) < 1e-6 for r in found)
    counts = {r.location_id: r.n for r in globe.zone_counts(obs, zones, cell=cell).collect()}
    assert counts == {k: sum(k == j for j, _ in expected) for k in {j for j, _ in expected}}


def test_many_zones_prune_by_touched_cells(make_obs, make_locations, cloud, centres):
    many = [(a, o, min(r, 40.0)) for a, o, r in centres * 3]
    found = {(r.location_id, r.id) for r in globe.within_radius(make_obs(cloud), rows(make_locations, many)).collect()}
    assert len(many) > globe.FEW_ZONES and found == expected_pairs(cloud, many)


def test_nearest_equals_brute_force(make_obs, make_locations, cloud, centres):
    got = {r.location_id: r.d_min for r in globe.nearest_distance(make_obs(cloud), rows(make_locations, centres)).collect()}
    assert got.keys() == set(range(len(centres)))
    for k, c in enumerate(centres):
        assert got[k] == pytest.approx(min(arc(p, c) for p in cloud), abs=1e-9)


def test_over_the_seam_and_off_the_globe(make_obs, make_locations):
    obs = make_obs([(0.0, 179.9), {"reclat": None}, {"reclong": None}, (95.0, 0.0)])
    zones = make_locations([{"lon": -179.9, "radius": 0.25}, {"lat": None}, {"lat": 95.0}, {"radius": -1.0, "lon": 179.9}])
    assert [(r.location_id, r.id) for r in globe.within_radius(obs, zones).collect()] == [(0, 0)]
    got = {r.location_id: r.d_min for r in globe.nearest_distance(obs, zones).collect()}
    assert got.keys() == {0, 3} and got[0] == pytest.approx(0.2)
    assert globe.nearest_distance(obs.limit(0), zones).count() == 0 and globe.within_radius(obs.limit(0), zones).count() == 0
    assert globe.within_radius(obs, zones.limit(0)).count() == 0


def test_a_zone_at_a_pole_touches_few_cells(make_locations):
    zones = make_locations([{"lat": lat, "lon": 100.0} for lat in (0.0, 60.0, 85.0, 89.0, 90.0)])
    cells = {r.location_id: r["count"] for r in globe.touched_cells(zones, 0.5).groupBy("location_id").count().collect()}
    assert max(cells.values()) <= 2 * cells[0]
