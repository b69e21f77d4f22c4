import math
import random

import numpy as np
import pytest

from geoscope.operators import forecast, locations


def by_id(df):
    return {r.location_id: r for r in df.collect()}


def test_isolated_location(make_obs, make_locations):
    obs = make_obs([(80.0, 170.0)] * 3)
    locs = make_locations([{"lat": -60.0, "lon": -100.0, "env_factor": 1.0, "hist_weight": 1.0, "horizon": 50}])
    p = locations.fall_probabilities(obs, locs).first()
    assert p.n == 0 and abs(p.p_found - 0.05 * 1.5) < 1e-12 and abs(p.p_fell - 0.02 * 1.5) < 1e-12
    assert locations.estimated_mass(obs, locs).first().estimated_mass is None
    assert locations.probable_class(obs, locs).first().probable_class is None
    assert locations.zone_statistics(obs, locs, 2025).count() == 0
    assert locations.impact_probability(obs, locs).first().impact_probability == 0.02 * 0.5 * 3.0
    assert locations.reliability_index(obs, locs).first().reliability == 20
    rate = forecast.temporal_base_rate(obs, locs).first()
    assert rate.n == 0 and rate.avg_mass == 10.0 and rate.frequency == 0.001 and abs(rate.base_rate - 1e-4) < 1e-15
    assert locations.region_comparison(obs, locs).count() == 0
    assert locations.region_comparison(obs, locs, shape="radius").count() == 3


def test_confident_location(make_obs, make_locations):
    obs = make_obs([{"reclat": i / 100, "reclong": -i / 50, "year": 1900 + i} for i in range(60)])
    locs = make_locations([{"horizon": 5, "env_factor": 1.0, "hist_weight": 1.0}])
    row = locations.confidence_reason(locations.confidence_score(obs, locs)).first()
    assert row.score == 100.0 and row.reason == "high"
    index = locations.reliability_index(obs, locs).first()
    assert index.n_near == 60 and index.reliability == 100 and index.tier == "success"
    impact = locations.impact_scores(obs, locs).first()
    assert impact.density_factor == 1.0 and impact.proximity_factor == 1.0
    assert impact.confidence == int((0.35 + 0.45 + (1 - 0.3) * 0.2) * 100)


@pytest.mark.parametrize("n,expected", [(4, 0), (5, 1)])
def test_zone_charts_need_five_rows(make_obs, make_locations, n, expected):
    obs, locs = make_obs([(0.1, 0.1)] * n), make_locations([{}])
    assert locations.zone_top_types(obs, locs).count() == expected
    assert locations.zone_timeline(obs, locs).count() == expected
    assert locations.zone_mass_histogram(obs, locs).count() == expected
    assert locations.zone_density(obs, locs).count() == expected
    assert locations.zone_density(obs, locs, shape="box").count() == 1


def test_unknown_years_do_not_count_for_the_timeline(make_obs, make_locations):
    obs = make_obs([{"year": y} for y in (0, 0, 1901, 1902, 1911, 1912)])
    assert locations.zone_timeline(obs, make_locations([{}])).count() == 0
    obs = make_obs([{"year": y} for y in (0, 1900, 1901, 1902, 1911, 1912)])
    rows = {r.decade: r.n for r in locations.zone_timeline(obs, make_locations([{}])).collect()}
    assert rows == {1900: 3, 1910: 2}


def test_main_classes_and_ties(make_obs, make_locations):
    obs = make_obs([{"recclass": c} for c in ("b", "a", "b", "a", "c", "d", "d", "d")])
    row = locations.zone_statistics(obs, make_locations([{}]), 2025).first()
    assert row.main_classes == "d, a, b" and row.dominant_class == "d" and row.dominant_share == 37.5
    assert row.mean_age == 125 and row.region_share == 100.0
    assert locations.probable_class(obs, make_locations([{}])).first().probable_class == "d"
    two = locations.zone_statistics(make_obs([(0, 0), (0, 0)]), make_locations([{}]), 2025).first()
    assert two.main_classes is None and two.n == 2


def test_geometric_mean_mass(make_obs, make_locations):
    obs = make_obs([{"mass_g": m} for m in (1.0, 10.0, 100.0, 1000.0, 10.0, 100.0)])
    got = locations.estimated_mass(obs, make_locations([{}])).first().estimated_mass
    assert abs(got - 10 ** (9 / 6)) < 1e-9
    assert locations.estimated_mass(make_obs([{}] * 5), make_locations([{}])).first().estimated_mass is None


def series(base, factor, cap, horizon):
    out, c = [], 0.0
    for i in range(horizon + 1):
        p = min(cap, base * factor * (1 + i * 0.02))
        c = p if i == 0 else 1 - (1 - p) * (1 - c)
        out.append((p, c))
    return out


def rates(spark, rows):
    return spark.createDataFrame(rows, "location_id long, horizon int, base_rate double")


def test_cumulative_probability_by_hand(spark):
    rows = forecast.temporal_forecast(rates(spark, [(1, 10, 0.05)]), 2025).filter("category = 'medium'").collect()
    got = {r.i: r.cumulative for r in rows}
    assert abs(got[0] - 0.05) < 1e-12 and abs(got[1] - 0.09845) < 1e-12 and abs(got[10] - 0.46331044) < 1e-8
    assert {r.year for r in rows} == set(range(2025, 2036))


@pytest.mark.parametrize("horizon", [1, 2, 7, 50])
def test_series_thresholds_milestones_and_sums(spark, horizon):
    base = [0.0001, 0.03, 0.25, 0.5]
    table = rates(spark, [(k, horizon, b) for k, b in enumerate(base)])
    curve = {}
    for r in forecast.temporal_forecast(table, 2025).collect():
        curve.setdefault((r.location_id, r.category), {})[r.i] = (r.annual, r.cumulative)
    years = {(r.location_id, r.category): r for r in forecast.threshold_years(table, 2025).collect()}
    sums = {(r.location_id, r.category): r.expected for r in forecast.expected_impacts(table).collect()}
    marks = {(r.location_id, r.category, r.milestone): r for r in forecast.horizon_milestones(table, 2025).collect()}
    for k, b in enumerate(base):
        for name, factor, cap in forecast.CATEGORIES:
            expected = series(b, factor, cap, horizon)
            np.testing.assert_allclose([curve[k, name][i] for i in range(horizon + 1)], expected)
            values = [c for _, c in expected]
            assert values == sorted(values) and 0 <= values[0] and values[-1] <= 1
            for t in forecast.THRESHOLDS:
                first = next((2025 + i for i, c in enumerate(values) if c >= t), None)
                assert years[k, name][f"year_{int(t * 100)}"] == first
            assert sums[k, name] == pytest.approx(sum(p for p, _ in expected[:horizon]))
            for m, at in enumerate((max(1, horizon // 3), max(2, 2 * horizon // 3), horizon), 1):
                assert marks[k, name, m].probability == pytest.approx(values[min(at, horizon)])


def test_grid_counts_equal_brute_force(make_obs, make_locations):
    rng = random.Random(9)
    # Whole and half steps put many points exactly on the edge of a grid point's disc.
    points = [(rng.randrange(-16, 17) / 4, rng.randrange(-16, 17) / 4) for _ in range(60)] + [(0.0, 0.0)] * 5
    radius, steps = 3.0, 24
    locs = make_locations([{"radius": radius}, {"lat": 1.7, "lon": -0.33, "radius": 1.1}])
    got = {}
    for r in forecast.spatial_probability_grid(make_obs(points), locs, steps).collect():
        got[r.location_id, r.i, r.j] = (r.n, r.probability)
    expected = {}
    for k, (lat, lon, rad) in enumerate(((0.0, 0.0, radius), (1.7, -0.33, 1.1))):
        step = rad * 2 / steps
        for i in range(steps + 1):
            for j in range(steps + 1):
                y, x = lat - rad + i * step, lon - rad + j * step
                away = math.sqrt((y - lat) ** 2 + (x - lon) ** 2)
                if away > rad:
                    continue
                n = sum(math.sqrt((p[0] - y) ** 2 + (p[1] - x) ** 2) <= rad / 3 for p in points)
                p = min(0.95, n / (math.pi * (rad / 3) ** 2) / 5) * (1 - away / rad * 0.3)
                expected[k, i, j] = (n, pytest.approx(p))
    assert got == expected


def test_cubic_forecast_equals_polyfit(make_obs):
    rng = random.Random(4)
    years = [y for y in range(1900, 1930) for _ in range(rng.randrange(1, 9))]
    rows = forecast.count_forecast(make_obs([{"year": y} for y in years])).orderBy("year").collect()
    known, counts = np.unique(years, return_counts=True)
    fit = np.polyfit(known - 1915.0, counts, 3)
    assert [r.year for r in rows] == list(range(1930, 1960))
    np.testing.assert_allclose([r.n for r in rows], np.polyval(fit, np.arange(1930, 1960) - 1915.0), rtol=1e-7)
    assert all(abs(r.lower - 0.8 * r.n) < 1e-9 and abs(r.upper - 1.2 * r.n) < 1e-9 for r in rows)
    assert forecast.count_forecast(make_obs([{"year": 1900 + i} for i in range(9)])).count() == 0


def test_unknown_years_can_be_left_out(make_obs, make_locations):
    years = [0, 0, 1900, 1950, 2000, 0, 1990]
    obs = make_obs([{"year": y} for y in years] + [{"year": 0, "reclat": 40.0}])
    locs = make_locations([{}, {"lat": 40.0}])
    known = {r.location_id: r for r in locations.zone_statistics(obs, locs, 2025, exclude_unknown_year=True).collect()}
    assert (known[0].n, known[0].first_year, known[0].last_year, known[0].mean_age) == (7, 1900, 2000, 65)
    assert (known[1].n, known[1].first_year, known[1].last_year, known[1].mean_age) == (1, None, None, None)
    every = {r.location_id: r for r in locations.zone_statistics(obs, locs, 2025).collect()}
    assert (every[0].first_year, every[1].mean_age) == (0, 2025)
    score = {x: locations.confidence_score(make_obs([{"year": y} for y in [0] + [2000] * 6]), make_locations([{}]), exclude_unknown_year=x).first().score for x in (True, False)}
    assert score[True] < score[False]
