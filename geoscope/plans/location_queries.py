"""Queries that score and describe query locations."""

from __future__ import annotations

from geoscope.operators import forecast, locations
from geoscope.plans import derived as d
from geoscope.plans.registry import add
from geoscope.plans.staging import obs

YEAR = d.AS_OF_YEAR

_DISTANCE = "sqrt((reclat - lat) * (reclat - lat) + (reclong - lon) * (reclong - lon))"
_SQUARE = "reclat BETWEEN lat - {r} AND lat + {r} AND reclong BETWEEN lon - {r} AND lon + {r}"
_ROW = "location_id, lat, lon, radius, id, recclass, fall, reclat, reclong, mass_g, log_mass, year, decade"
_DISC = f", z AS (SELECT {_ROW} FROM parameters CROSS JOIN obs WHERE {_DISTANCE} <= radius)"
_BOX = f", z AS (SELECT {_ROW} FROM parameters CROSS JOIN obs WHERE {_SQUARE.format(r='radius')})"
_NEAREST = f", m AS (SELECT location_id, min({_DISTANCE}) AS d_min FROM parameters CROSS JOIN obs GROUP BY 1)"
_COUNT = ", c AS (SELECT p.location_id, count(z.id) AS n FROM parameters p LEFT JOIN z USING (location_id) GROUP BY 1)"
_PI = "pi()"


def _on(operator, *args, **kwargs):
    """Run an operator on the catalogue and the parameterised locations."""
    return lambda s, p: operator(obs(s, p), d.parameters(s, p), *args, **kwargs)


# --- reliability and impact ------------------------------------------------------------------

add(
    "reliability_index",
    _on(locations.reliability_index),
    "obs parameters",
    f"""{_NEAREST}, c AS (SELECT location_id, count(*) FILTER (WHERE {_DISTANCE} <= 5) AS n_near
         FROM parameters CROSS JOIN obs GROUP BY 1),
    r AS (SELECT location_id, n_near, d_min, CAST(floor(
        greatest(0, 100 - d_min * 10) * CAST('0.4' AS DOUBLE)
        + least(100, CAST(n_near * 2 AS DOUBLE)) * CAST('0.4' AS DOUBLE) + 20) AS INT) AS reliability
        FROM c JOIN m USING (location_id))
    --result
    SELECT *, CASE WHEN reliability < 30 THEN 'danger' WHEN reliability < 70 THEN 'warning' ELSE 'success' END AS tier
    FROM r""",
    rounded="d_min",
)

_FACTORS = f"""{_DISC}{_COUNT}{_NEAREST}, f AS (SELECT location_id, n, horizon,
    greatest(CAST('0.1' AS DOUBLE), least(1, 1 / (d_min + CAST('0.1' AS DOUBLE)))) AS proximity_factor,
    least(1, CAST(n AS DOUBLE) / 20) AS density_factor,
    greatest(CAST('0.3' AS DOUBLE), least(CAST('0.8' AS DOUBLE), CAST(horizon AS DOUBLE) / 100)) AS time_factor,
    CASE WHEN detection = 'Fell' THEN CAST('1.2' AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS fall_factor
    FROM parameters JOIN c USING (location_id) JOIN m USING (location_id))"""

add(
    "impact_probability",
    _on(locations.impact_probability),
    "obs parameters",
    f"""{_FACTORS}
    --result
    SELECT location_id, n, least(0.15e0, 0.02e0 * (0.5e0 + density_factor * 1.5e0)
      * (0.5e0 + CAST(horizon AS DOUBLE) / 20)) AS impact_probability FROM f""",
    rounded="impact_probability",
)
add(
    "impact_confidence",
    _on(locations.impact_confidence),
    "obs parameters",
    f"""{_FACTORS}, s AS (SELECT location_id, CAST(floor((proximity_factor * 0.35e0 + density_factor * 0.45e0
      + (1 - time_factor) * 0.2e0) * 100) AS INT) AS confidence FROM f)
    SELECT location_id, confidence,
      CASE WHEN confidence < 40 THEN 'danger' WHEN confidence < 75 THEN 'warning' ELSE 'success' END AS tier FROM s""",
)
add(
    "impact_factors",
    _on(locations.impact_factors),
    "obs parameters",
    f"""{_FACTORS}
    --result
    SELECT location_id, proximity_factor, density_factor, time_factor, fall_factor FROM f""",
    rounded="proximity_factor density_factor time_factor fall_factor",
)

# --- zones ------------------------------------------------------------------------------------

_REGION = """, g AS (SELECT location_id, count(*) AS n_region FROM parameters CROSS JOIN obs
    WHERE {test} GROUP BY 1)"""
_BOX_REGION = _REGION.format(test=_SQUARE.format(r="radius * 3"))
_DISC_REGION = _REGION.format(test=f"{_DISTANCE} <= radius * 3")
_CLASSES = """, k AS (SELECT location_id, recclass, count(*) AS n FROM z GROUP BY 1, 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY n DESC, recclass) AS rank,
          sum(n) OVER (PARTITION BY location_id) AS total FROM k)"""


def _zone_statistics(zone: str, region: str) -> str:
    return f"""{zone}{region}{_CLASSES}, t AS (SELECT location_id, string_agg(recclass, ', ' ORDER BY rank) AS main_classes,
        max(n) AS top FROM o WHERE rank <= 3 GROUP BY 1),
    h AS (SELECT location_id, recclass AS dominant_class FROM o WHERE rank = 1),
    b AS (SELECT location_id, max(radius) AS radius, count(*) AS n, sum(mass_g) AS total_mass, avg(mass_g) AS mean_mass,
        median(mass_g) AS median_mass, min(year) AS first_year, max(year) AS last_year, avg(year) AS mean_year
        FROM z GROUP BY 1)
    --result
    SELECT location_id, n, total_mass, mean_mass, median_mass, first_year, last_year,
      CAST(trunc({YEAR} - mean_year) AS INT) AS mean_age,
      CASE WHEN n >= 3 THEN main_classes END AS main_classes,
      CASE WHEN n >= 3 THEN dominant_class END AS dominant_class,
      CASE WHEN n >= 3 THEN CAST(top AS DOUBLE) / n * 100 END AS dominant_share,
      n / ({_PI} * radius * radius) AS concentration, n_region, CAST(n AS DOUBLE) / n_region * 100 AS region_share
    FROM b JOIN t USING (location_id) JOIN h USING (location_id) JOIN g USING (location_id)"""


_STATISTICS_ROUNDED = "total_mass mean_mass median_mass dominant_share concentration region_share"
add(
    "zone_stats",
    _on(locations.zone_statistics, YEAR),
    "obs parameters",
    _zone_statistics(_BOX, _BOX_REGION),
    rounded=_STATISTICS_ROUNDED,
)
add(
    "zone_stats_radius",
    _on(locations.zone_statistics, YEAR, shape="radius"),
    "obs parameters",
    _zone_statistics(_DISC, _DISC_REGION),
    rounded=_STATISTICS_ROUNDED,
)
# Year 0 stands for an unknown year.
_KNOWN_YEARS = "(SELECT * REPLACE (nullif(year, 0) AS year) FROM z)"
add(
    "zone_stats_known_years",
    _on(locations.zone_statistics, YEAR, exclude_unknown_year=True),
    "obs parameters",
    _zone_statistics(_BOX, _BOX_REGION).replace("FROM z GROUP BY 1)\n    --result", f"FROM {_KNOWN_YEARS} GROUP BY 1)\n    --result"),
    rounded=_STATISTICS_ROUNDED,
)
add(
    "zone_observations",
    _on(locations.zone_observations),
    "obs parameters",
    f"""{_BOX}, b AS (SELECT location_id, max(radius) AS radius, count(*) AS n FROM z GROUP BY 1),
    e AS (SELECT *, n / ({_PI} * radius * radius) AS concentration FROM b)
    --result
    SELECT location_id, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM obs) * 100 AS catalogue_share,
      concentration, round(concentration, 2) > 0.1e0 AS above FROM e""",
    rounded="catalogue_share concentration",
)


def _comparison(zone: str, region: str, joined: str, per_degree: str = "1") -> str:
    return f"""{zone}{region}, b AS (SELECT location_id, count(*) AS n_local FROM z GROUP BY 1),
    w AS (SELECT count(*) AS n_global FROM obs),
    q AS (SELECT location_id, radius, coalesce(n_local, 0) AS n_local, coalesce(n_region, 0) AS n_region, n_global
        FROM parameters {joined} JOIN b USING (location_id) {joined} JOIN g USING (location_id) CROSS JOIN w),
    a AS (SELECT *, n_local / ({_PI} * radius * radius * {per_degree}) AS dl,
        n_region / ({_PI} * radius * radius * 9 * {per_degree}) AS dr,
        n_global / (4 * {_PI} * 6371 * 6371) AS dg FROM q),
    u AS (SELECT location_id, 'local' AS scope, n_local AS n, dl AS density, greatest(dl, dr, dg) AS top FROM a
        UNION ALL SELECT location_id, 'region', n_region, dr, greatest(dl, dr, dg) FROM a
        UNION ALL SELECT location_id, 'global', n_global, dg, greatest(dl, dr, dg) FROM a)
    --result
    SELECT location_id, scope, n, density, density / top AS relative_density FROM u"""


add(
    "region_comparison",
    _on(locations.region_comparison),
    "obs parameters",
    _comparison(_BOX, _BOX_REGION, "INNER"),
    rounded="density relative_density",
)
add(
    "region_comparison_radius",
    _on(locations.region_comparison, shape="radius"),
    "obs parameters",
    _comparison(_DISC, _DISC_REGION, "LEFT"),
    rounded="density relative_density",
)
add(
    "region_comparison_km2",
    _on(locations.region_comparison, shape="radius", units="km2"),
    "obs parameters",
    _comparison(_DISC, _DISC_REGION, "LEFT", f"(6371 * {_PI} / 180) * (6371 * {_PI} / 180)"),
    rounded="density relative_density",
)

_TOP = "{zone}" + _CLASSES + " SELECT location_id, recclass, n, rank FROM o WHERE rank <= 5 AND total >= 5"
_HISTOGRAM = """{zone}, x AS (SELECT location_id, min(log_mass) AS lo, max(log_mass) AS hi, count(*) AS total
      FROM z GROUP BY 1),
    b AS (SELECT location_id, lo, hi, CASE WHEN hi > lo
      THEN CAST(least(floor((log_mass - lo) / (hi - lo) * 10), 9) AS INT) ELSE 0 END AS bin
      FROM z JOIN x USING (location_id) WHERE total >= 5)
    --result
    SELECT location_id, bin, lo + (hi - lo) / 10 * bin AS low, lo + (hi - lo) / 10 * (bin + 1) AS high, count(*) AS n
    FROM b GROUP BY location_id, bin, lo, hi"""
_TIMELINE = """{zone}, t AS (SELECT location_id, decade, count(*) AS n FROM z WHERE year > 0 GROUP BY 1, 2)
    SELECT location_id, decade, n FROM (SELECT *, sum(n) OVER (PARTITION BY location_id) AS total FROM t) q
    WHERE total >= 5"""
for _suffix, _shape, _zone in (("", "box", _BOX), ("_radius", "radius", _DISC)):
    add(
        f"zone_top_types{_suffix}",
        _on(locations.zone_top_types, shape=_shape),
        "obs parameters",
        _TOP.format(zone=_zone),
    )
    add(
        f"zone_mass_histogram{_suffix}",
        _on(locations.zone_mass_histogram, shape=_shape),
        "obs parameters",
        _HISTOGRAM.format(zone=_zone),
        rounded="low high",
    )
    add(
        f"zone_timeline{_suffix}",
        _on(locations.zone_timeline, shape=_shape),
        "obs parameters",
        _TIMELINE.format(zone=_zone),
    )

_CELLS = """, t AS (SELECT location_id, CAST(floor(reclat / 0.25e0) AS BIGINT) AS cell_lat,
      CAST(floor(reclong / 0.25e0) AS BIGINT) AS cell_lon, count(*) AS n FROM z GROUP BY 1, 2, 3)"""
add(
    "zone_density",
    _on(locations.zone_density),
    "obs parameters",
    f""", z AS (SELECT {_ROW} FROM parameters CROSS JOIN obs WHERE {_DISTANCE} <= radius * 2){_CELLS}
    SELECT location_id, cell_lat, cell_lon, n
    FROM (SELECT *, sum(n) OVER (PARTITION BY location_id) AS total FROM t) q WHERE total >= 5""",
)
add(
    "zone_density_box",
    _on(locations.zone_density, shape="box"),
    "obs parameters",
    f"{_BOX}{_CELLS} SELECT location_id, cell_lat, cell_lon, n FROM t",
)

# --- probabilities, mass, class, confidence ---------------------------------------------------

add(
    "fall_probabilities",
    _on(locations.fall_probabilities),
    "obs parameters",
    f"""{_DISC}, c AS (SELECT p.*, count(z.id) AS n, count(z.id) FILTER (WHERE z.fall = 'Found') AS found,
        count(z.id) FILTER (WHERE z.fall = 'Fell') AS fell
        FROM parameters p LEFT JOIN z USING (location_id) GROUP BY ALL),
    s1 AS (SELECT *, least(3, n / ({_PI} * radius * radius)
        / ((SELECT count(*) FROM obs) / (180e0 * 360e0) + 0.0001e0)) AS ratio FROM c),
    s2 AS (SELECT *, CASE WHEN n < 5 THEN 0.05e0 ELSE least(0.95e0, CAST(found AS DOUBLE) / n * ratio * 0.7e0) END AS a,
        CASE WHEN n < 5 THEN 0.02e0 ELSE least(0.5e0, CAST(fell AS DOUBLE) / n * ratio * 0.3e0) END AS b FROM s1),
    s3 AS (SELECT * REPLACE (
        CASE WHEN n >= 5 AND abs(a - b) < 0.05e0
          THEN CASE WHEN a > b THEN a + 0.05e0 ELSE greatest(0.01e0, a - 0.03e0) END ELSE a END AS a,
        CASE WHEN n >= 5 AND abs(a - b) < 0.05e0
          THEN CASE WHEN a > b THEN greatest(0.01e0, b - 0.03e0) ELSE b + 0.05e0 END ELSE b END AS b) FROM s2),
    s4 AS (SELECT *, least(1.5e0, 1 + horizon / 100e0) AS tf, 0.7e0 + env_factor * 0.3e0 AS ef,
        0.7e0 + hist_weight * 0.3e0 AS hf FROM s3),
    s5 AS (SELECT location_id, n, least(0.95e0, least(0.95e0, a * tf) * ef * hf) AS a,
        least(0.7e0, least(0.7e0, b * tf) * ef * hf) AS b FROM s4)
    --result
    SELECT location_id, n, CASE WHEN a + b > 1 THEN a * (0.95e0 / (a + b)) ELSE a END AS p_found,
      CASE WHEN a + b > 1 THEN b * (0.95e0 / (a + b)) ELSE b END AS p_fell FROM s5""",
    rounded="p_found p_fell",
)
add(
    "estimated_mass",
    _on(locations.estimated_mass),
    "obs parameters",
    f"""{_DISC}
    --result
    SELECT p.location_id, CASE WHEN count(z.id) > 5 THEN pow(10, avg(log_mass)) END AS estimated_mass
    FROM parameters p LEFT JOIN z USING (location_id) GROUP BY 1""",
    rounded="estimated_mass",
)
add(
    "probable_class",
    _on(locations.probable_class),
    "obs parameters",
    f"""{_DISC}{_CLASSES}
    SELECT p.location_id, CASE WHEN total > 5 THEN recclass END AS probable_class
    FROM parameters p LEFT JOIN (SELECT * FROM o WHERE rank = 1) t USING (location_id)""",
)

_SCORE = f"""{_DISC}{_CLASSES}, b AS (SELECT p.location_id, p.radius, horizon, complexity, env_factor, hist_weight,
        count(z.id) AS n, max(year) - min(year) AS span, stddev_samp(year) AS year_std,
        (stddev_samp(reclat) + stddev_samp(reclong)) / 2 AS dispersion
        FROM parameters p LEFT JOIN z USING (location_id) GROUP BY ALL),
    v AS (SELECT b.*, CAST(o.n AS DOUBLE) / o.total AS dominance
        FROM b LEFT JOIN (SELECT * FROM o WHERE rank = 1) o USING (location_id)),
    s AS (SELECT location_id, n, horizon, radius, complexity, greatest(0, least(100, (
        50 + least(1, n / 50e0) * 30 - least(40, horizon * 0.8e0)
        + CASE WHEN n <= 5 THEN 0 WHEN span > 50 AND year_std > 15 THEN 15 WHEN span > 20 THEN 10 ELSE 0 END
        + CASE WHEN n <= 10 THEN 0 WHEN dispersion > 0.5e0 THEN 10 WHEN dispersion > 0.2e0 THEN 5 ELSE 0 END
        + CASE WHEN n <= 5 THEN 0 WHEN dominance > 0.7e0 THEN 10 WHEN dominance > 0.5e0 THEN 5 ELSE 0 END)
        * (0.8e0 + (1 - abs(complexity - 5) / 10e0) * 0.3e0) * (0.9e0 + env_factor * 0.2e0)
        * (0.9e0 + hist_weight * 0.2e0))) AS score FROM v)"""
add(
    "confidence_score",
    _on(locations.confidence_score),
    "obs parameters",
    f"""{_SCORE}
    --result
    SELECT * FROM s""",
    rounded="score",
)
add(
    "confidence_score_known_years",
    _on(locations.confidence_score, exclude_unknown_year=True),
    "obs parameters",
    f"""{_SCORE.replace('LEFT JOIN z USING (location_id) GROUP BY ALL', f'LEFT JOIN {_KNOWN_YEARS} z USING (location_id) GROUP BY ALL')}
    --result
    SELECT * FROM s""",
    rounded="score",
)
add(
    "confidence_reason",
    lambda s, p: locations.confidence_reason(locations.confidence_score(obs(s, p), d.parameters(s, p))),
    "obs parameters",
    f"""{_SCORE}
    --result
    SELECT *, CASE WHEN score < 30 THEN CASE WHEN horizon > 30 THEN 'low_far_horizon' WHEN radius < 2
        THEN 'low_small_radius' ELSE 'low_sparse_data' END
      WHEN score < 70 THEN CASE WHEN horizon > 15 THEN 'medium_long_horizon' WHEN complexity > 8 OR complexity < 3
        THEN 'medium_complexity' ELSE 'medium_distribution' END ELSE 'high' END AS reason FROM s""",
    rounded="score",
)

# --- forecasts --------------------------------------------------------------------------------

_RATES = f"""{_DISC}{_NEAREST}, b AS (SELECT p.location_id, horizon, count(z.id) AS n, avg(mass_g) AS mass,
        count(DISTINCT year) AS years, max(year) - min(year) AS span
        FROM parameters p LEFT JOIN z USING (location_id) GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN n = 0 THEN 0.001e0 WHEN years > 1 THEN CAST(n AS DOUBLE) / greatest(1, span)
        ELSE 0.01e0 END AS frequency FROM b),
    rates AS (SELECT location_id, horizon, n, coalesce(mass, (SELECT avg(mass_g) FROM obs)) AS avg_mass, frequency,
        least(0.5e0, frequency * greatest(0.1e0, least(1e0, 1 / (greatest(0.1e0, d_min) + 0.1e0)))) AS base_rate
        FROM f JOIN m USING (location_id))"""
_SERIES = f"""{_RATES}, categories(category, factor, cap) AS (
      VALUES ('small', 2e0, 0.95e0), ('medium', 1e0, 0.75e0), ('large', 0.2e0, 0.25e0)),
    steps AS (SELECT location_id, horizon, category, CAST(i AS INT) AS i,
        least(cap, base_rate * factor * (1 + i * 0.02e0)) AS annual
        FROM rates CROSS JOIN categories CROSS JOIN range(51) r(i) WHERE i <= horizon),
    series AS (SELECT *, 1 - exp(sum(ln(1 - annual)) OVER (PARTITION BY location_id, category ORDER BY i))
        AS cumulative FROM steps)"""


def _rates(spark, path):
    return forecast.temporal_base_rate(obs(spark, path), d.parameters(spark, path))


add(
    "temporal_base_rate",
    _rates,
    "obs parameters",
    f"""{_RATES}
    --result
    SELECT * FROM rates""",
    rounded="avg_mass frequency base_rate",
)
add(
    "temporal_forecast",
    lambda s, p: forecast.temporal_forecast(_rates(s, p), YEAR),
    "obs parameters",
    f"""{_SERIES}
    --result
    SELECT location_id, category, i, annual, cumulative, CAST({YEAR} + i AS INT) AS year FROM series""",
    rounded="annual cumulative",
)
add(
    "cumulative_probability",
    lambda s, p: forecast.temporal_forecast(_rates(s, p), YEAR).select("location_id", "category", "year", "cumulative"),
    "obs parameters",
    f"""{_SERIES}
    --result
    SELECT location_id, category, CAST({YEAR} + i AS INT) AS year, cumulative FROM series""",
    rounded="cumulative",
)
add(
    "threshold_years",
    lambda s, p: forecast.threshold_years(_rates(s, p), YEAR),
    "obs parameters",
    f"""{_SERIES} SELECT location_id, category, """
    + ", ".join(
        f"CAST(min(CASE WHEN cumulative >= {t} THEN {YEAR} + i END) AS INT) AS year_{name}"
        for t, name in ((0.25, 25), (0.5, 50), (0.75, 75))
    )
    + " FROM series GROUP BY 1, 2",
)
add(
    "horizon_milestones",
    lambda s, p: forecast.horizon_milestones(_rates(s, p), YEAR),
    "obs parameters",
    f"""{_SERIES}, a AS (SELECT location_id, CAST(k AS INT) AS milestone, horizon, CASE k WHEN 1
        THEN greatest(1, horizon // 3) WHEN 2 THEN greatest(2, horizon * 2 // 3) ELSE horizon END AS ahead
        FROM parameters CROSS JOIN range(1, 4) r(k)),
    v AS (SELECT a.location_id, category, milestone, CAST({YEAR} + ahead AS INT) AS by_year, cumulative AS probability
        FROM a JOIN series s ON s.location_id = a.location_id AND s.i = least(ahead, a.horizon))
    --result
    SELECT *, CASE WHEN probability >= 0.75 THEN 'very_probable' WHEN probability >= 0.5 THEN 'probable'
      WHEN probability >= 0.25 THEN 'possible' ELSE 'unlikely' END AS band FROM v""",
    rounded="probability",
)
add(
    "expected_impacts",
    lambda s, p: forecast.expected_impacts(_rates(s, p)),
    "obs parameters",
    f"""{_SERIES}
    --result
    SELECT location_id, category, sum(annual) FILTER (WHERE i < horizon) AS expected FROM series GROUP BY 1, 2""",
    rounded="expected",
)
_GRID = f""", near AS (SELECT location_id, lat, lon, radius, reclat, reclong FROM parameters CROSS JOIN obs
      WHERE {_DISTANCE} <= radius * 4 / 3 + 0.001),
    points AS (SELECT location_id, lat, lon, radius, CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j,
      lat - radius + a.i * (radius * 2 / 80) AS grid_lat, lon - radius + b.j * (radius * 2 / 80) AS grid_lon
      FROM parameters CROSS JOIN range(81) a(i) CROSS JOIN range(81) b(j)),
    disc AS (SELECT *, sqrt((grid_lat - lat) * (grid_lat - lat) + (grid_lon - lon) * (grid_lon - lon)) AS away
      FROM points),
    hits AS (SELECT location_id, i, j, count(*) AS n FROM disc JOIN near USING (location_id)
      WHERE sqrt((reclat - grid_lat) * (reclat - grid_lat) + (reclong - grid_lon) * (reclong - grid_lon))
        <= disc.radius / 3 GROUP BY 1, 2, 3),
    counted AS (SELECT disc.*, coalesce(n, 0) AS n FROM disc LEFT JOIN hits USING (location_id, i, j)
      WHERE away <= radius)
    --result
    SELECT location_id, i, j, grid_lat, grid_lon, n,
      least(0.95e0, n / ({_PI} * (radius / 3) * (radius / 3)) / 5) * (1 - away / radius * 0.3e0) AS probability
    FROM counted"""
add(
    "spatial_probability_grid",
    _on(forecast.spatial_probability_grid),
    "obs parameters",
    _GRID,
    rounded="grid_lat grid_lon probability",
)
add(
    "grid_neighbour_count",
    lambda s, p: forecast.spatial_probability_grid(obs(s, p), d.parameters(s, p)).select("location_id", "i", "j", "n"),
    "obs parameters",
    _GRID.split("--result")[0] + " SELECT location_id, i, j, n FROM counted",
)
add(
    "count_forecast",
    lambda s, p: forecast.count_forecast(obs(s, p)),
    "obs",
    # The same cubic from orthogonal polynomials over the years.
    """, y AS (SELECT CAST(year AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM obs WHERE year > 1800 GROUP BY year),
    c1 AS (SELECT avg(x) AS a0, avg(n) AS k0, count(*) AS s0, max(x) AS last FROM y),
    y1 AS (SELECT x, n, x - a0 AS p1, a0, k0, s0, last FROM y CROSS JOIN c1),
    c2 AS (SELECT sum(x * p1 * p1) / sum(p1 * p1) AS a1, sum(p1 * p1) / max(s0) AS b1,
        sum(n * p1) / sum(p1 * p1) AS k1, sum(p1 * p1) AS s1 FROM y1),
    y2 AS (SELECT y1.*, c2.*, (x - a1) * p1 - b1 AS p2 FROM y1 CROSS JOIN c2),
    c3 AS (SELECT sum(x * p2 * p2) / sum(p2 * p2) AS a2, sum(p2 * p2) / max(s1) AS b2,
        sum(n * p2) / sum(p2 * p2) AS k2 FROM y2),
    y3 AS (SELECT y2.*, c3.*, (x - a2) * p2 - b2 * p1 AS p3 FROM y2 CROSS JOIN c3),
    c4 AS (SELECT sum(n * p3) / sum(p3 * p3) AS k3 FROM y3),
    f AS (SELECT last + 1 + CAST(i AS DOUBLE) AS x, c1.*, c2.*, c3.*, k3
        FROM range(30) r(i) CROSS JOIN c1 CROSS JOIN c2 CROSS JOIN c3 CROSS JOIN c4),
    g AS (SELECT *, x - a0 AS p1, (x - a1) * (x - a0) - b1 AS p2 FROM f),
    h AS (SELECT CAST(x AS INT) AS year, k0 + k1 * p1 + k2 * p2 + k3 * ((x - a2) * p2 - b2 * p1) AS n FROM g),
    b AS (SELECT year, n, n * 0.8e0 AS lower, n * 1.2e0 AS upper FROM h)
    --result
    SELECT *, log10(CASE WHEN n <= 0 THEN 0.1e0 ELSE n END) AS log_n,
      log10(CASE WHEN lower <= 0 THEN 0.1e0 ELSE lower END) AS log_lower,
      log10(CASE WHEN upper <= 0 THEN 0.1e0 ELSE upper END) AS log_upper FROM b""",
    rounded="n lower upper log_n log_lower log_upper",
)
