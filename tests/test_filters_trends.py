import pytest

from geoscope.operators import facets, filters, trends


def ids(df):
    return sorted(r.id for r in df.collect())


def test_empty_facets_do_not_filter(make_obs):
    obs = make_obs([{"recclass": c} for c in ("L6", "H5", "all")])
    assert ids(filters.filter_obs(obs)) == [0, 1, 2]
    assert ids(filters.filter_obs(obs, classification="all", fall_type=[])) == [0, 1, 2]
    assert ids(filters.filter_obs(obs, classification=["all"])) == [2]
    assert ids(filters.filter_obs(obs, classification="H5")) == [1]


def test_ranges_are_inclusive_and_bad_ranges_ignored(make_obs):
    obs = make_obs([{"mass_g": m, "year": y} for m, y in ((10.0, 1800), (100.0, 1899), (101.0, 1900))])
    assert ids(filters.filter_obs(obs, mass_range=[1, 2])) == [0, 1]
    assert ids(filters.filter_obs(obs, mass_range=["a", "b"])) == [0, 1, 2]
    assert ids(filters.filter_obs(obs, decade_range=[1800, 1890])) == [0, 1]
    assert ids(filters.filter_year(obs, (1899, 1900))) == [1, 2]
    assert ids(filters.filter_year_valid(obs)) == [1, 2]


def test_long_lists_stay_one_predicate(make_obs):
    obs = make_obs([{"recclass": c} for c in ("c5", "zzz", "c1999")])
    chosen = filters.filter_class(obs, [f"c{i}" for i in range(2000)])
    assert ids(chosen) == [0, 2]
    assert chosen.schema == obs.schema
    assert "Join" not in chosen._jdf.queryExecution().optimizedPlan().toString()


def test_cross_filter_collapses_duplicates(make_obs, spark):
    obs = make_obs([(0, 0), (1, 1), (2, 2)])
    assert ids(filters.cross_filter(obs, spark.createDataFrame([(1,), (1,), (9,)], "id long"))) == [1]


def test_location_problems(make_locations):
    rows = make_locations(
        [{}, {"lat": 91.0}, {"horizon": 0}, {"horizon": 51}, {"detection": "x"}, {"lon": None}, {"detection": None}]
    )
    assert filters.valid_locations(rows).count() == 1
    reasons = {r.location_id: r.reason for r in filters.quarantine_locations(rows).collect()}
    assert reasons == {
        1: "coordinates", 2: "horizon", 3: "horizon", 4: "detection", 5: "coordinates", 6: "detection",
    }


def test_growth_and_rolling_mean(make_obs):
    years = [1900, 1900, 1905, 1905, 1910, 0, 1800]
    rows = trends.year_trend(make_obs([{"year": y} for y in years])).collect()
    assert [r.n for r in rows] == [2, 2, 1]
    assert [r.growth_rate for r in rows] == [0.0, 0.0, -50.0]
    assert [round(r.moving_avg, 4) for r in rows] == [2.0, 2.0, 1.6667]


def test_one_year_is_no_trend(make_obs):
    obs = make_obs([{"year": 1900}] * 3)
    assert trends.year_trend(obs).count() == 0
    assert trends.mass_by_year(obs).count() == 0
    assert trends.decade_fall_pivot(obs).count() == 0


def test_decade_without_fell_or_found(make_obs):
    obs = make_obs([{"year": 1900, "fall": "Unknown"}, {"year": 1955, "fall": "Fell"}])
    rows = {r.decade: r for r in trends.decade_fall_pivot(obs).collect()}
    assert rows[1900].total == 0 and rows[1900].pct_fell == 0.0 and rows[1900].log_total == -1.0
    assert rows[1950].pct_fell == 100.0 and rows[1950].mean_mass_found == 0.0


def test_ties_go_by_name_and_rest_family_is_last(make_obs):
    obs = make_obs([{"recclass": c} for c in ("Zz", "Aa", "Zz", "Aa", "Mm", "Qq", "Qq", "H5")])
    assert [r.recclass for r in facets.top_classes(obs, 3).collect()] == ["Aa", "Qq", "Zz"]
    shares = facets.class_group_share(obs).collect()
    assert [r.class_group for r in shares] == ["Chondrites H", "Autres"]
    assert abs(sum(r.percent for r in shares) - 100) < 1e-9


def test_histogram_counts_everything_once(make_obs):
    obs = make_obs([{"mass_g": float(m)} for m in (1, 10, 10, 1000, 99999, 100000)])
    rows = facets.mass_histogram(obs, bins=5).orderBy("bin").collect()
    assert [r.n for r in rows] == [1, 2, 0, 1, 2] and rows[0].low == 0.0 and rows[4].high == 5.0
    same = facets.mass_histogram(make_obs([{"mass_g": 7.0}] * 3), bins=5).orderBy("bin").collect()
    assert [r.n for r in same] == [3, 0, 0, 0, 0]
    assert facets.mass_histogram(obs.filter("false")).count() == 0


def test_marker_sizes(make_obs):
    sizes = facets.minmax_scale(make_obs([{"mass_g": m} for m in (1.0, 10.0, 100.0)]), 2.0).orderBy("id").collect()
    assert [r.point_size for r in sizes] == [3.0, 6.0, 9.0]
    assert {r.point_size for r in facets.minmax_scale(make_obs([(0, 0), (1, 1)]), 2.0).collect()} == {6.0}
    assert facets.minmax_scale(make_obs([(0, 0)]), 2.0).first().point_size == 9.0


def test_correlation_is_symmetric_with_unit_diagonal(make_obs):
    obs = make_obs([{"mass_g": m, "reclat": a, "reclong": 1.0} for m, a in ((1.0, 2.0), (2.0, 4.0), (3.0, 6.0))])
    cells = {(r.var_x, r.var_y): r["corr"] for r in facets.correlation_matrix(obs).collect()}
    assert len(cells) == 16 and abs(cells["mass_g", "reclat"] - 1) < 1e-12 and cells["mass_g", "mass_g"] == 1.0
    assert all(cells[a, b] == cells[b, a] for a, b in cells)
    assert cells["reclong", "reclong"] is None and cells["reclong", "mass_g"] is None


def test_no_found_gives_no_ratio(make_obs):
    row = facets.kpi_fall_ratio(make_obs([{"fall": "Fell"}])).first()
    assert row.fell == 1 and row.fell_found_ratio is None
    empty = facets.kpi_fall_ratio(make_obs([{}]).filter("false")).first()
    assert empty.n == 0 and empty.total_mass == 0


@pytest.mark.parametrize("size", [1, 999, 1001])
def test_lists_of_any_length_keep_rows_and_columns(spark, make_obs, size):
    obs = make_obs([{"recclass": c} for c in ("L6", "H5", "c0", "none")])
    found = filters.filter_class(obs, ["L6", *[f"c{i}" for i in range(size - 1)]])
    assert found.schema == obs.schema
    assert {r.recclass for r in found.collect()} == ({"L6", "c0"} if size > 1 else {"L6"})


def test_a_table_of_classes(spark, make_obs):
    obs = make_obs([{"recclass": c} for c in ("L6", "H5", "c0", "none")])
    listed = spark.range(100_000).selectExpr("concat('c', id) AS recclass").union(spark.createDataFrame([("L6",)], "recclass string"))
    found = filters.filter_class(obs, listed)
    assert found.schema == obs.schema and {r.recclass for r in found.collect()} == {"L6", "c0"}
