"""Queries on cleaning, filters, scalar columns, distributions and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoscope.functions import (
    clamp,
    class_group,
    confidence_tier,
    fall_code,
    log_transform,
    probability_band,
    reliability_tier,
)
from geoscope.operators import cleaning, facets, filters, ml, sketches, trends
from geoscope.plans import derived as d
from geoscope.plans.registry import add
from geoscope.plans.staging import kpi_sketches, new_path
from geoscope.plans.staging import obs as staged_obs
from geoscope.sources.catalogue import read_raw_csv, write_raw_csv

OBS_COLUMNS = ["id", "name", "recclass", "fall", "reclat", "reclong", "mass_g", "year", "decade"]
_OBS_LIST = ", ".join(OBS_COLUMNS)

# --- sources and cleaning -------------------------------------------------------------------

add("scan_raw", lambda s, p: d.raw_obs(s, p), "raw_obs", "SELECT * FROM raw_obs")



def scan_csv(spark, path):
    """The raw records as users have them: written as CSV, read by the CSV reader, then cleaned."""
    out = new_path(spark, "csv")
    write_raw_csv(d.raw_obs(spark, path), out)
    return cleaning.clean_obs(read_raw_csv(spark, out), d.AS_OF_YEAR).select(*OBS_COLUMNS)


add("scan_csv", scan_csv, "obs", f"SELECT {_OBS_LIST} FROM obs")

add(
    "clean_obs",
    lambda s, p: d.obs(s, p).select(*OBS_COLUMNS, "adjusted_mass", "log_mass"),
    "obs",
    f"SELECT {_OBS_LIST}, mass_g AS adjusted_mass, log_mass FROM obs",
    rounded="log_mass",
)

_TYPED = "SELECT id, name, recclass, fall, reclat, reclong, m AS mass_g, y AS year_num FROM typed"
_NOT_ISLAND = "(reclat IS NULL OR reclong IS NULL OR NOT (reclat = 0 AND reclong = 0))"
_PRESENT = "reclat IS NOT NULL AND reclong IS NOT NULL AND m IS NOT NULL"
_YEAR_OK = "(y IS NULL OR y BETWEEN 1000 AND 2025)"

add("coerce_numeric", lambda s, p: cleaning.coerce_numeric(d.raw_obs(s, p)), "raw_obs typed", _TYPED)
add(
    "drop_null_island",
    lambda s, p: cleaning.drop_null_island(cleaning.coerce_numeric(d.raw_obs(s, p))),
    "raw_obs typed",
    f"{_TYPED} WHERE {_NOT_ISLAND}",
)
add(
    "drop_missing",
    lambda s, p: cleaning.drop_missing(cleaning.coerce_numeric(d.raw_obs(s, p))),
    "raw_obs typed",
    f"{_TYPED} WHERE {_PRESENT}",
)
add(
    "fix_nonpositive_mass",
    lambda s, p: cleaning.fix_nonpositive_mass(cleaning.coerce_numeric(d.raw_obs(s, p))).select("id", "mass_g"),
    "raw_obs typed",
    "SELECT id, CASE WHEN m <= 0 THEN (SELECT min(m) FROM typed WHERE m > 0) ELSE m END AS mass_g FROM typed",
)
add(
    "plausible_year",
    lambda s, p: cleaning.plausible_year(cleaning.coerce_numeric(d.raw_obs(s, p)), d.AS_OF_YEAR),
    "raw_obs typed",
    f"{_TYPED} WHERE {_YEAR_OK}",
)
add(
    "impute_median_mass",
    lambda s, p: cleaning.impute_median_mass(cleaning.coerce_numeric(d.raw_obs(s, p))).select("id", "mass_g"),
    "raw_obs typed",
    "SELECT id, coalesce(m, (SELECT median(m) FROM typed)) AS mass_g FROM typed",
)
add(
    "floor_mass",
    lambda s, p: cleaning.floor_mass(cleaning.coerce_numeric(d.raw_obs(s, p))).select("id", "mass_g"),
    "raw_obs typed",
    "SELECT id, CASE WHEN m < 1 THEN CAST(1 AS DOUBLE) ELSE m END AS mass_g FROM typed",
)
add(
    "derive_log_mass",
    lambda s, p: cleaning.derive_log_mass(cleaning.floor_mass(cleaning.coerce_numeric(d.raw_obs(s, p)))).select(
        "id", "adjusted_mass", "log_mass"
    ),
    "raw_obs typed",
    """SELECT id, a AS adjusted_mass, log10(a) AS log_mass
       FROM (SELECT id, CASE WHEN m < 1 THEN CAST(1 AS DOUBLE) ELSE m END AS a FROM typed) t""",
    rounded="log_mass",
)
add(
    "fill_year",
    lambda s, p: cleaning.fill_year(cleaning.coerce_numeric(d.raw_obs(s, p))).select("id", "year"),
    "raw_obs typed",
    "SELECT id, CAST(floor(coalesce(y, 0)) AS INT) AS year FROM typed",
)
add(
    "derive_decade",
    lambda s, p: cleaning.derive_decade(cleaning.fill_year(cleaning.coerce_numeric(d.raw_obs(s, p)))).select(
        "id", "decade"
    ),
    "raw_obs typed",
    "SELECT id, CAST(floor(floor(coalesce(y, 0)) / 10) AS INT) * 10 AS decade FROM typed",
)
add(
    "fill_unknown",
    lambda s, p: cleaning.fill_unknown(cleaning.coerce_numeric(d.raw_obs(s, p))).select("id", "fall", "recclass"),
    "raw_obs typed",
    "SELECT id, coalesce(fall, 'Unknown') AS fall, coalesce(recclass, 'Unknown') AS recclass FROM typed",
)
add(
    "clean_report",
    lambda s, p: cleaning.clean_report(d.raw_obs(s, p), d.AS_OF_YEAR),
    "raw_obs typed",
    f""", k AS (SELECT * FROM typed WHERE {_NOT_ISLAND} AND {_PRESENT}),
    small AS (SELECT min(m) AS mm FROM k WHERE m > 0)
    SELECT (SELECT count(*) FROM typed) AS rows_in,
      (SELECT count(*) FROM typed WHERE reclat = 0 AND reclong = 0) AS null_island_rows,
      (SELECT count(*) FROM typed WHERE {_NOT_ISLAND} AND NOT ({_PRESENT})) AS missing_value_rows,
      (SELECT count(*) FROM k WHERE m <= 0) AS corrected_masses,
      (SELECT mm FROM small) AS min_valid_mass,
      (SELECT count(*) FROM k WHERE NOT {_YEAR_OK}) AS implausible_year_rows,
      (SELECT count(*) FROM k WHERE {_YEAR_OK}) AS rows_out,
      (SELECT greatest(min(CASE WHEN m <= 0 THEN mm ELSE m END), CAST(1 AS DOUBLE))
         FROM k CROSS JOIN small WHERE {_YEAR_OK}) AS min_mass_after""",
)

_RAW_TYPES = {
    "id": "bigint",
    "name": "string",
    "recclass": "string",
    "mass_raw": "string",
    "fall": "string",
    "year_raw": "string",
    "reclat": "double",
    "reclong": "double",
}
add(
    "null_profile",
    lambda s, p: cleaning.null_profile(d.raw_obs(s, p)),
    "raw_obs",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM raw_obs"""
        for c, t in _RAW_TYPES.items()
    ),
)
add(
    "fill_by_type",
    lambda s, p: cleaning.fill_by_type(d.raw_obs(s, p)),
    "raw_obs",
    "SELECT coalesce(id, 0) AS id, "
    + ", ".join(f"coalesce({c}, 'Non spécifié') AS {c}" for c, t in _RAW_TYPES.items() if t == "string")
    + ", coalesce(reclat, 0) AS reclat, coalesce(reclong, 0) AS reclong FROM raw_obs",
)
add(
    "fill_by_type_coerced",
    lambda s, p: cleaning.fill_by_type(d.raw_obs(s, p), coerce_text=True),
    "raw_obs",
    """SELECT coalesce(id, 0) AS id, coalesce(name, 'Non spécifié') AS name,
       coalesce(recclass, 'Non spécifié') AS recclass, coalesce(TRY_CAST(mass_raw AS DOUBLE), 0) AS mass_raw,
       coalesce(fall, 'Non spécifié') AS fall, coalesce(TRY_CAST(year_raw AS DOUBLE), 0) AS year_raw,
       coalesce(reclat, 0) AS reclat, coalesce(reclong, 0) AS reclong FROM raw_obs""",
)

# --- filters --------------------------------------------------------------------------------

FACETS = {
    "mass_range": [1, 5],
    "classification": ["L6", "H5", "LL5", "Eucrite", "Lunar"],
    "fall_type": ["Found", "Fell"],
    "decade_range": [1800, 2020],
}
FACET_SQL = """mass_g BETWEEN 10 AND 100000 AND recclass IN ('L6', 'H5', 'LL5', 'Eucrite', 'Lunar')
    AND fall IN ('Found', 'Fell') AND decade BETWEEN 1800 AND 2020"""


def _filter(name, build, where):
    add(name, lambda s, p: build(staged_obs(s, p)).select(*OBS_COLUMNS), "obs", f"SELECT {_OBS_LIST} FROM obs WHERE {where}")


_filter("filter_obs", lambda o: filters.filter_obs(o, **FACETS), FACET_SQL)
_filter("filter_mass", lambda o: filters.filter_mass(o, [2, 4]), "mass_g BETWEEN 100 AND 10000")
_filter("filter_class", lambda o: filters.filter_class(o, ["L6", "CM2"]), "recclass IN ('L6', 'CM2')")
_filter("filter_fall", lambda o: filters.filter_fall(o, "Fell"), "fall = 'Fell'")
_filter("filter_decade", lambda o: filters.filter_decade(o, [1900, 1950]), "decade BETWEEN 1900 AND 1950")
_filter("filter_year", lambda o: filters.filter_year(o, [1895, 1905]), "year BETWEEN 1895 AND 1905")
_filter("filter_year_valid", lambda o: filters.filter_year_valid(o), "year > 1800")
add(
    "cross_filter",
    lambda s, p: filters.cross_filter(staged_obs(s, p), d.selection(s, p)).select(*OBS_COLUMNS),
    "obs selection",
    f"SELECT {_OBS_LIST} FROM obs WHERE id IN (SELECT id FROM selection)",
)

_BAD_PLACE = "lat IS NULL OR lon IS NULL OR lat < -90 OR lat > 90 OR lon < -180 OR lon > 180"
_BAD_HORIZON = "horizon IS NULL OR horizon < 1 OR horizon > 50"
_BAD_DETECTION = "detection IS NULL OR detection NOT IN ('Fell', 'Found', 'all')"
add(
    "valid_locations",
    lambda s, p: filters.valid_locations(d.requests(s, p)),
    "requests",
    f"SELECT * FROM requests WHERE NOT ({_BAD_PLACE}) AND NOT ({_BAD_HORIZON}) AND NOT ({_BAD_DETECTION})",
)
add(
    "quarantine_locations",
    lambda s, p: filters.quarantine_locations(d.requests(s, p)),
    "requests",
    f"""SELECT * FROM (SELECT *, CASE WHEN {_BAD_PLACE} THEN 'coordinates' WHEN {_BAD_HORIZON} THEN 'horizon'
        WHEN {_BAD_DETECTION} THEN 'detection' END AS reason FROM requests) t WHERE reason IS NOT NULL""",
)

# --- scalar columns -------------------------------------------------------------------------

_FAMILY_SQL = """CASE
    WHEN recclass LIKE '%Iron%' THEN 'Météorites de fer'
    WHEN recclass LIKE '%Pallasite%' OR recclass LIKE '%Mesosiderite%' THEN 'Métallo-rocheuses'
    WHEN recclass LIKE '%Eucrite%' OR recclass LIKE '%Diogenite%' OR recclass LIKE '%Howardite%'
      THEN 'Achondrites HED'
    WHEN recclass LIKE '%Ureilite%' OR recclass LIKE '%Angrite%' OR recclass LIKE '%Aubrite%'
      THEN 'Autres achondrites'
    WHEN recclass LIKE 'H%' THEN 'Chondrites H'
    WHEN recclass LIKE 'L%' THEN 'Chondrites L'
    WHEN substr(recclass, 1, 2) IN ('CI', 'CM', 'CO', 'CV', 'CK', 'CR') THEN 'Chondrites carbonées'
    WHEN recclass LIKE 'E%' THEN 'Chondrites E'
    WHEN recclass LIKE '%Martian%' OR recclass LIKE '%Shergottite%' OR recclass LIKE '%Nakhlite%'
      THEN 'Météorites martiennes'
    ELSE 'Autres' END"""

add(
    "log_transform",
    lambda s, p: cleaning.coerce_numeric(d.raw_obs(s, p)).select("id", log_transform("mass_g").alias("log_value")),
    "raw_obs typed",
    "SELECT id, log10(CASE WHEN m <= 0 THEN CAST('0.1' AS DOUBLE) ELSE m END) AS log_value FROM typed",
    rounded="log_value",
)
add(
    "class_group",
    lambda s, p: staged_obs(s, p).select("id", "recclass", class_group("recclass").alias("class_group")),
    "obs",
    f"SELECT id, recclass, {_FAMILY_SQL} AS class_group FROM obs",
)
add(
    "class_group_fixed_order",
    lambda s, p: staged_obs(s, p).select("id", "recclass", class_group("recclass", fixed_order=True).alias("class_group")),
    "obs",
    f"""SELECT id, recclass, CASE WHEN recclass LIKE 'LL%' THEN 'Chondrites LL'
        WHEN recclass LIKE '%Lunar%' THEN 'Météorites lunaires' ELSE {_FAMILY_SQL} END AS class_group FROM obs""",
)
add(
    "minmax_scale",
    lambda s, p: facets.minmax_scale(staged_obs(s, p), point_size=4.0).select("id", "point_size"),
    "obs",
    """SELECT id, 3 + (log_mass - lo) / (hi - lo) * 12 AS point_size
       FROM obs CROSS JOIN (SELECT min(log_mass) AS lo, max(log_mass) AS hi FROM obs) x""",
    rounded="point_size",
)

# A number between 0 and 1 (and one between 0 and 100) that every observation has.
def _unit(spark, path):
    return staged_obs(spark, path).select("id", (F.pmod(F.col("id") * 37, F.lit(1001)).cast("double") / 1000).alias("p"))


_UNIT_SQL = "SELECT id, CAST((id * 37) % 1001 AS DOUBLE) / 1000 AS p FROM obs"

add(
    "probability_band",
    lambda s, p: _unit(s, p).withColumn("band", probability_band("p")),
    "obs",
    f"""SELECT id, p, CASE WHEN p >= 0.75 THEN 'very_probable' WHEN p >= 0.5 THEN 'probable'
        WHEN p >= 0.25 THEN 'possible' ELSE 'unlikely' END AS band FROM ({_UNIT_SQL}) t""",
)
add(
    "confidence_tier",
    lambda s, p: _unit(s, p).select(
        "id",
        confidence_tier(F.col("p") * 100).alias("confidence_tier"),
        reliability_tier(F.col("p") * 100).alias("reliability_tier"),
    ),
    "obs",
    f"""SELECT id,
        CASE WHEN p * 100 < 40 THEN 'danger' WHEN p * 100 < 75 THEN 'warning' ELSE 'success' END AS confidence_tier,
        CASE WHEN p * 100 < 30 THEN 'danger' WHEN p * 100 < 70 THEN 'warning' ELSE 'success' END AS reliability_tier
        FROM ({_UNIT_SQL}) t""",
)
add(
    "clamp",
    lambda s, p: staged_obs(s, p).select("id", clamp("mass_g", 10, 5000).alias("clamped")),
    "obs",
    "SELECT id, CASE WHEN mass_g < 10 THEN CAST(10 AS DOUBLE) WHEN mass_g > 5000 THEN CAST(5000 AS DOUBLE) "
    "ELSE mass_g END AS clamped FROM obs",
)
add(
    "log1p_expm1",
    lambda s, p: staged_obs(s, p).select(
        "id", F.log1p("mass_g").alias("log_target"), F.expm1(F.log1p("log_mass")).alias("restored")
    ),
    "obs",
    "SELECT id, ln(1 + mass_g) AS log_target, log_mass AS restored FROM obs",
    rounded="log_target restored",
)
add(
    "fall_code",
    lambda s, p: staged_obs(s, p).select("id", fall_code("fall").alias("fall_code")),
    "obs",
    "SELECT id, CAST(CASE WHEN fall = 'Fell' THEN 0 WHEN fall = 'Found' THEN 1 END AS INT) AS fall_code FROM obs",
)

# --- distributions --------------------------------------------------------------------------

_FACETED = f"(SELECT * FROM obs WHERE {FACET_SQL})"


def _faceted(spark, path):
    return filters.filter_obs(staged_obs(spark, path), **FACETS)


add(
    "filtered_kpi_summary",
    lambda s, p: facets.kpi_summary(_faceted(s, p)),
    "obs",
    f"""SELECT count(*) AS n, sum(mass_g) AS total_mass, avg(mass_g) AS mean_mass, median(mass_g) AS median_mass,
        count(DISTINCT recclass) AS n_classes, min(year) AS min_year, max(year) AS max_year FROM {_FACETED} t""",
    rounded="total_mass mean_mass median_mass",
)
add(
    "kpi_summary",
    lambda s, p: facets.kpi_summary(staged_obs(s, p)),
    "obs",
    f"""SELECT count(*) AS n, sum(mass_g) AS total_mass, avg(mass_g) AS mean_mass, median(mass_g) AS median_mass,
        count(DISTINCT recclass) AS n_classes, min(year) AS min_year, max(year) AS max_year FROM obs""",
    rounded="total_mass mean_mass median_mass",
)


def _sketched(where: str) -> str:
    """Sketched figures from the exact middle masses: each stands for the mass in the middle of its bucket."""
    grown = f"({sketches.GROWTH!r}::DOUBLE)"
    middle = f"2 / ({grown} + 1) * pow({grown}, ceil(ln({{}}) / ln({grown})))"
    return f""", f AS (SELECT * FROM obs WHERE {where}), v AS (SELECT list_sort(list(mass_g)) AS v, count(*) AS k FROM f)
    --result
    SELECT count(*) AS n, sum(mass_g) AS total_mass, avg(mass_g) AS mean_mass, min(year) AS min_year, max(year) AS max_year,
        count(DISTINCT recclass) AS n_classes,
        (SELECT ({middle.format('v[(k + 1) // 2]')} + {middle.format('v[k // 2 + 1]')}) / 2 FROM v) AS median_mass FROM f"""


add(
    "kpi_sketched",
    lambda s, p: sketches.kpi_from_sketches(kpi_sketches(s, p)),
    "obs",
    _sketched("true"),
    rounded="total_mass mean_mass median_mass",
)
add(
    "filtered_kpi_sketched",
    lambda s, p: sketches.kpi_from_sketches(sketches.filter_sketches(kpi_sketches(s, p), "Fell", (1850, 1950))),
    "obs",
    _sketched("fall = 'Fell' AND decade BETWEEN 1850 AND 1950"),
    rounded="total_mass mean_mass median_mass",
)
add(
    "kpi_fall_ratio",
    lambda s, p: facets.kpi_fall_ratio(staged_obs(s, p)),
    "obs",
    f"""SELECT count(*) AS n, sum(mass_g) AS total_mass, avg(mass_g) AS mean_mass,
        count(*) FILTER (WHERE fall = 'Fell') AS fell, count(*) FILTER (WHERE fall = 'Found') AS found,
        CAST(count(*) FILTER (WHERE fall = 'Fell') AS DOUBLE) / count(*) FILTER (WHERE fall = 'Found')
          AS fell_found_ratio FROM obs""",
    rounded="total_mass mean_mass fell_found_ratio",
)
add(
    "class_group_share",
    lambda s, p: facets.class_group_share(staged_obs(s, p)),
    "obs",
    f"""SELECT {_FAMILY_SQL} AS class_group, count(*) AS n,
        CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM obs) * 100 AS "percent" FROM obs GROUP BY 1""",
    rounded="percent",
)
add(
    "fall_share",
    lambda s, p: facets.fall_share(staged_obs(s, p)),
    "obs",
    """SELECT fall, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM obs) * 100 AS "percent"
       FROM obs GROUP BY fall""",
    rounded="percent",
)
add(
    "mass_histogram",
    lambda s, p: facets.mass_histogram(staged_obs(s, p)),
    "obs",
    """, x AS (SELECT min(log_mass) AS lo, max(log_mass) AS hi FROM obs),
    c AS (SELECT CAST(least(floor((log_mass - lo) / (hi - lo) * 50), 49) AS INT) AS bin, count(*) AS n
          FROM obs CROSS JOIN x GROUP BY 1)
    --result
    SELECT CAST(b.bin AS INT) AS bin, lo + (hi - lo) / 50 * b.bin AS low, lo + (hi - lo) / 50 * (b.bin + 1) AS high,
      coalesce(n, 0) AS n FROM range(50) b(bin) CROSS JOIN x LEFT JOIN c ON c.bin = b.bin""",
    rounded="low high",
)
add(
    "top_classes",
    lambda s, p: facets.top_classes(staged_obs(s, p)),
    "obs",
    "SELECT recclass, count(*) AS n FROM obs GROUP BY recclass ORDER BY n DESC, recclass LIMIT 10",
)
add(
    "correlation_matrix",
    lambda s, p: facets.correlation_matrix(staged_obs(s, p)),
    "obs",
    ", v AS (SELECT mass_g, reclat, reclong, CAST(year AS DOUBLE) AS year FROM obs)\n--result\n"
    + " UNION ALL ".join(
        f"SELECT '{x}' AS var_x, '{y}' AS var_y, corr({x}, {y}) AS corr FROM v"
        for x in facets.CORRELATED
        for y in facets.CORRELATED
    ),
    rounded="corr",
)
add(
    "density_grid",
    lambda s, p: facets.density_grid(staged_obs(s, p), cell=2.0),
    "obs",
    f"""SELECT CAST(floor(reclat / 2) AS BIGINT) AS cell_lat, CAST(floor(reclong / 2) AS BIGINT) AS cell_lon,
        count(*) AS n FROM obs GROUP BY 1, 2""",
)

# --- trends ---------------------------------------------------------------------------------

_YEARLY = ", y AS (SELECT year, count(*) AS n FROM obs WHERE year > 1800 GROUP BY year)"

add(
    "decade_counts",
    lambda s, p: trends.decade_counts(staged_obs(s, p)),
    "obs",
    "SELECT decade, count(*) AS n, log10(count(*)) AS log_n FROM obs GROUP BY decade",
    rounded="log_n",
)


def year_trend(spark, path):
    return trends.year_trend(staged_obs(spark, path))


add(
    "year_trend",
    year_trend,
    "obs",
    f"""{_YEARLY}
    --result
    SELECT year, n, avg(n) OVER (ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving_avg,
      coalesce((CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY year) - 1) * 100, 0) AS growth_rate,
      log10(n) AS log_n, n > (SELECT avg(n) + stddev_samp(n) FROM y) AS is_peak FROM y""",
    rounded="moving_avg growth_rate log_n",
)
add(
    "year_peaks",
    lambda s, p: trends.year_peaks(staged_obs(s, p)),
    "obs",
    f"""{_YEARLY}
    --result
    SELECT year, n, log10(n) AS log_n FROM y WHERE n > (SELECT avg(n) + stddev_samp(n) FROM y)""",
    rounded="log_n",
)
add(
    "rolling_mean",
    lambda s, p: trends.year_trend(staged_obs(s, p)).select("year", "moving_avg"),
    "obs",
    f""", y AS (SELECT year, count(*) AS n FROM obs WHERE year > 1800 GROUP BY year)
    --result
    SELECT year, avg(n) OVER (ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS moving_avg FROM y""",
    rounded="moving_avg",
)
add(
    "pct_change",
    lambda s, p: trends.year_trend(staged_obs(s, p)).select("year", "growth_rate"),
    "obs",
    f""", y AS (SELECT year, count(*) AS n FROM obs WHERE year > 1800 GROUP BY year)
    --result
    SELECT year, coalesce((CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY year) - 1) * 100, 0) AS growth_rate FROM y""",
    rounded="growth_rate",
)
_LOG0 = "log10(CASE WHEN {0} <= 0 THEN CAST('0.1' AS DOUBLE) ELSE {0} END) AS log_{0}"
add(
    "decade_fall_pivot",
    lambda s, p: trends.decade_fall_pivot(staged_obs(s, p)),
    "obs",
    f""", g AS (SELECT decade, count(*) FILTER (WHERE fall = 'Fell') AS fell,
        count(*) FILTER (WHERE fall = 'Found') AS found,
        coalesce(avg(mass_g) FILTER (WHERE fall = 'Fell'), 0) AS mean_mass_fell,
        coalesce(avg(mass_g) FILTER (WHERE fall = 'Found'), 0) AS mean_mass_found
        FROM obs WHERE year > 1800 GROUP BY decade), t AS (SELECT *, fell + found AS total FROM g)
    --result
    SELECT *, CASE WHEN total = 0 THEN 0 ELSE CAST(fell AS DOUBLE) / total * 100 END AS pct_fell,
      {_LOG0.format("fell")}, {_LOG0.format("found")}, {_LOG0.format("total")} FROM t""",
    rounded="mean_mass_fell mean_mass_found pct_fell log_fell log_found log_total",
)
add(
    "decade_fall_mass",
    lambda s, p: trends.decade_fall_mass(staged_obs(s, p)),
    "obs",
    """SELECT decade, fall, avg(mass_g) AS mean_mass, count(*) AS n, sum(mass_g) AS total_mass
       FROM obs WHERE year > 1800 GROUP BY decade, fall""",
    rounded="mean_mass total_mass",
)
add(
    "mass_by_year",
    lambda s, p: trends.mass_by_year(staged_obs(s, p)),
    "obs",
    """SELECT year, avg(mass_g) AS mean_mass, median(mass_g) AS median_mass, count(*) AS n,
       log10(avg(mass_g)) AS log_mean, log10(median(mass_g)) AS log_median FROM obs WHERE year > 1800 GROUP BY year""",
    rounded="mean_mass median_mass log_mean log_median",
)
add(
    "ml_frame",
    lambda s, p: ml.ml_frame(staged_obs(s, p)).select("id", "reclat", "reclong", "year", "mass_g", "recclass", "fall_code"),
    "obs",
    """SELECT id, reclat, reclong, CAST(year AS DOUBLE) AS year, mass_g, recclass,
       CAST(CASE fall WHEN 'Fell' THEN 0 ELSE 1 END AS DOUBLE) AS fall_code
       FROM obs WHERE fall IN ('Fell', 'Found')""",
)
