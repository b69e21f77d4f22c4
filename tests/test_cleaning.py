import pytest
from pyspark.sql import functions as F

from geoscope.functions import class_group, fall_code, log_transform, probability_band
from geoscope.operators import cleaning
from geoscope.sources import (
    RAW_SCHEMA,
    read_filtered_json,
    read_obs,
    read_raw_csv,
    write_filtered_json,
    write_obs,
)


@pytest.fixture
def raw(spark):
    def build(rows):
        out = []
        for i, row in enumerate(rows):
            full = {
                "id": i, "name": "x", "recclass": "L6", "mass_raw": "10", "fall": "Fell", "year_raw": "1900",
                "reclat": 1.0, "reclong": 1.0,
            }
            full.update(row)
            out.append(tuple(full.values()))
        return spark.createDataFrame(out, RAW_SCHEMA)

    return build


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_nonpositive_masses_take_the_smallest_positive_one_then_the_floor(raw):
    rows = raw([{"mass_raw": m} for m in ("0", "-5", "3", "0.2")])
    fixed = cleaning.fix_nonpositive_mass(cleaning.coerce_numeric(rows))
    assert column(fixed, "mass_g") == [0.2, 0.2, 3.0, 0.2]
    assert column(cleaning.clean_obs(rows, 2025), "mass_g") == [1.0, 1.0, 3.0, 1.0]


def test_smallest_mass_is_taken_before_the_year_filter(raw):
    rows = raw([{"mass_raw": "0"}, {"mass_raw": "2", "year_raw": "860"}, {"mass_raw": "7"}])
    assert column(cleaning.clean_obs(rows, 2025), "mass_g") == [2.0, 7.0]


def test_null_island(raw):
    rows = raw([{"reclat": a, "reclong": b} for a, b in ((0.0, 0.0), (0.0, 5.0), (None, 0.0))])
    assert column(cleaning.clean_obs(rows, 2025), "id") == [1]
    assert column(cleaning.drop_null_island(cleaning.coerce_numeric(rows)), "id") == [1, 2]


def test_year_bounds_and_unknown_year(raw):
    rows = raw([{"year_raw": y} for y in ("999", "1000", "2025", "2026", None, "n/a")])
    obs = cleaning.clean_obs(rows, 2025)
    assert column(obs, "id") == [1, 2, 4, 5]
    assert column(obs, "year") == [1000, 2025, 0, 0]


def test_decade_and_unknown_text(raw):
    obs = cleaning.clean_obs(
        raw([{"year_raw": "1999"}, {"year_raw": "2000", "fall": None}, {"year_raw": None, "recclass": None}]), 2025
    )
    assert column(obs, "decade") == [1990, 2000, 0]
    assert column(obs, "fall") == ["Fell", "Unknown", "Fell"]
    assert column(obs, "recclass") == ["L6", "L6", "Unknown"]


def test_text_that_is_no_number(raw):
    rows = raw([{"mass_raw": m} for m in ("n/a", "", "NaN", "5d", "1e3", " 7 ")])
    assert column(cleaning.coerce_numeric(rows), "mass_g") == [None, None, None, None, 1000.0, 7.0]


def test_impute_median_and_floor_keep_or_fill_nulls(raw):
    rows = cleaning.coerce_numeric(raw([{"mass_raw": m} for m in ("1", "3", "8", "10", "n/a")]))
    assert column(cleaning.impute_median_mass(rows), "mass_g")[-1] == 5.5
    assert column(cleaning.floor_mass(rows), "mass_g")[-1] is None


def test_report_counts_each_step_once(raw):
    rows = raw(
        [
            {},
            {"reclat": 0.0, "reclong": 0.0},
            {"mass_raw": "n/a"},
            {"reclat": None},
            {"mass_raw": "-1"},
            {"year_raw": "2101"},
        ]
    )
    report = cleaning.clean_report(rows, 2025).first()
    assert report.rows_in == 6 and report.null_island_rows == 1 and report.missing_value_rows == 2
    assert report.corrected_masses == 1 and report.implausible_year_rows == 1 and report.rows_out == 2
    assert report.rows_out == cleaning.clean_obs(rows, 2025).count()


def test_empty_input_keeps_the_schema(raw):
    empty = cleaning.clean_obs(raw([]), 2025)
    assert empty.count() == 0 and "decade" in empty.columns


def test_class_families(spark):
    names = ["LL5", "Lunar", "Howardite", "CM2", "CH3", "Iron, IIIAB", "Unknown", "Martian (nakhlite)", "EH4"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    families = [r[0] for r in df.select(class_group("c")).collect()]
    assert families == [
        "Chondrites L", "Chondrites L", "Achondrites HED", "Chondrites carbonées", "Autres", "Météorites de fer",
        "Autres", "Météorites martiennes", "Chondrites E",
    ]
    fixed = [r[0] for r in df.select(class_group("c", fixed_order=True)).collect()]
    assert fixed[:2] == ["Chondrites LL", "Météorites lunaires"] and fixed[2:] == families[2:]


def test_scalar_edges(spark):
    df = spark.createDataFrame([(0.0,), (-3.0,), (100.0,), (None,)], "v double")
    assert [r[0] for r in df.select(log_transform("v")).collect()] == [-1.0, -1.0, 2.0, None]
    bands = spark.createDataFrame([(0.75,), (0.5,), (0.25,), (0.2,)], "p double").select(probability_band("p"))
    assert [r[0] for r in bands.collect()] == ["very_probable", "probable", "possible", "unlikely"]
    codes = spark.createDataFrame([("Fell",), ("Found",), ("Unknown",)], "f string").select(fall_code("f"))
    assert [r[0] for r in codes.collect()] == [0, 1, None]


def test_csv_is_read_by_header_name(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'name,id,nametype,recclass,mass (g),fall,year,reclat,reclong,GeoLocation\n'
        '"A, b",1,Valid,L5,21,Fell,1880,50.775,6.08333,"(50.775, 6.08333)"\n'
        "C,2,Valid,H6,,Found,,bad,1.5,\n"
    )
    rows = read_raw_csv(spark, str(path)).orderBy("id").collect()
    assert rows[0].asDict() == {
        "id": 1, "name": "A, b", "recclass": "L5", "mass_raw": "21", "fall": "Fell", "year_raw": "1880",
        "reclat": 50.775, "reclong": 6.08333,
    }
    assert rows[1].mass_raw is None and rows[1].reclat is None and rows[1].reclong == 1.5


def test_stored_observations_come_back(raw, spark, tmp_path):
    obs = cleaning.clean_obs(raw([{"year_raw": y} for y in ("1890", "1995", None)]), 2025)
    write_obs(obs, str(tmp_path / "obs"))
    write_filtered_json(obs, str(tmp_path / "json"))
    expected = obs.orderBy("id").collect()
    assert read_obs(spark, str(tmp_path / "obs")).orderBy("id").collect() == expected
    assert read_filtered_json(spark, str(tmp_path / "json")).orderBy("id").collect() == expected
    one = read_obs(spark, str(tmp_path / "obs")).filter(F.col("decade") == 1990)
    assert "PartitionFilters: [isnotnull(decade" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_quotes_null_words_and_odd_numbers(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'id,name,recclass,mass (g),fall,year,reclat,reclong\n'
        '1,"x ""q"", y",L6,21,Fell,1900,1.5,2.5\n'
        "2,NA,NA,n/a,null,N/A,NaN,2\n"
        "3,c,,5,Found,1e12,1d,nan\n"
        '4,"two\nlines",H5,7,Fell,2000,1e1,-3\n'
    )
    rows = {r.id: r for r in read_raw_csv(spark, str(path), multi_line=True).collect()}
    assert (rows[1].name, rows[1].recclass, rows[1].mass_raw, rows[1].reclat, rows[1].reclong) == ('x "q", y', "L6", "21", 1.5, 2.5)
    assert (rows[2].name, rows[2].recclass, rows[2].fall, rows[2].reclat) == (None, None, None, None)
    assert (rows[3].recclass, rows[3].reclat, rows[3].reclong) == (None, None, None)
    assert (rows[4].name, rows[4].reclat) == ("two\nlines", 10.0)
    typed = cleaning.coerce_numeric(read_raw_csv(spark, str(path), multi_line=True))
    years = {r.id: (r.year, r.decade) for r in cleaning.derive_decade(cleaning.fill_year(typed)).collect()}
    assert years == {1: (1900, 1900), 2: (0, 0), 3: (0, 0), 4: (2000, 2000)}


def test_nan_is_missing_in_chain_report_and_profile(spark):
    schema = "id long, name string, recclass string, mass_raw string, fall string, year_raw string, reclat double, reclong double"
    nan = float("nan")
    rows = [(1, "a", "L6", "5", "Fell", "1900", nan, 1.0), (2, "b", "L6", "5", "Fell", "1900", 1.0, 1.0)]
    raw = spark.createDataFrame(rows, schema)
    assert cleaning.clean_report(raw, 2025).first().rows_out == cleaning.clean_obs(raw, 2025).count() == 1
    assert {r.column: r.nulls for r in cleaning.null_profile(raw).collect()}["reclat"] == 1
