"""Input views derived from the driver's tables.

Every view is given once as text that means the same in Spark SQL and in DuckDB: Spark reads it
through ``selectExpr``, the SQL checks inline it as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoscope.operators.cleaning import clean_obs

AS_OF_YEAR = 2025

_RAW_OBS = {
    "id": "o_orderkey",
    "name": "concat('Site-', CAST(o_orderkey AS STRING))",
    "recclass": """CASE (o_orderkey*31 + o_custkey) % 20
        WHEN 0 THEN 'L6' WHEN 1 THEN 'L6' WHEN 2 THEN 'L6' WHEN 3 THEN 'H5' WHEN 4 THEN 'H5' WHEN 5 THEN 'H5'
        WHEN 6 THEN 'LL5' WHEN 7 THEN 'H4' WHEN 8 THEN 'L5' WHEN 9 THEN 'Iron, IIIAB' WHEN 10 THEN 'Pallasite, PMG'
        WHEN 11 THEN 'Eucrite' WHEN 12 THEN 'Ureilite' WHEN 13 THEN 'CM2' WHEN 14 THEN 'EH4'
        WHEN 15 THEN 'Martian (shergottite)' WHEN 16 THEN 'Lunar' WHEN 17 THEN 'Acapulcoite' WHEN 18 THEN 'H6'
        ELSE NULL END""",
    "mass_raw": """CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(CASE o_custkey % 4
        WHEN 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100
        WHEN 1 THEN CAST(floor(o_totalprice) AS BIGINT) % 10000
        WHEN 2 THEN CAST(floor(o_totalprice) AS BIGINT)
        ELSE CAST(floor(o_totalprice) AS BIGINT) * 37 END AS STRING) END""",
    "fall": """CASE o_orderstatus WHEN 'F' THEN 'Fell' WHEN 'O' THEN 'Found'
        ELSE CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Found' END END""",
    "year_raw": """CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 401 = 0 THEN '2101'
        WHEN o_orderkey % 503 = 0 THEN '860'
        ELSE CAST(1800 + CAST(floor(sqrt(CAST((o_orderkey*7919) % 48841 AS DOUBLE))) AS BIGINT) AS STRING) END""",
    "reclat": """CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN CAST(0 AS DOUBLE)
        ELSE CAST((o_custkey*7919) % 17001 - 8500 + (o_orderkey*13) % 200 - 100 AS DOUBLE)
             / CAST(100 AS DOUBLE) END""",
    "reclong": """CASE WHEN o_orderkey % 61 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN CAST(0 AS DOUBLE)
        ELSE CAST((o_custkey*104729) % 35801 - 17900 + (o_orderkey*29) % 200 - 100 AS DOUBLE)
             / CAST(100 AS DOUBLE) END""",
}

_LOCATIONS = {
    "location_id": "s_suppkey",
    "lat": "CAST((s_suppkey*7919) % 17001 - 8500 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "lon": "CAST((s_suppkey*104729) % 35801 - 17900 AS DOUBLE) / CAST(100 AS DOUBLE)",
}

# Per-location parameters over the ranges the widgets allow.
_PARAMETERS = {
    **_LOCATIONS,
    "radius": "CAST(s_suppkey % 20 + 1 AS DOUBLE) / CAST(2 AS DOUBLE)",
    "horizon": "CAST(s_suppkey % 50 + 1 AS INT)",
    "detection": "CASE s_suppkey % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'Fell' ELSE 'Found' END",
    "env_factor": "CAST(s_suppkey % 11 AS DOUBLE) / CAST(10 AS DOUBLE)",
    "hist_weight": "CAST(s_suppkey % 9 AS DOUBLE) / CAST(8 AS DOUBLE)",
    "complexity": "CAST(s_suppkey % 10 + 1 AS INT)",
}

# Requests of which some are out of range.
_REQUESTS = {
    "location_id": "s_suppkey",
    "lat": "CAST((s_suppkey*7919) % 19001 - 9500 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "lon": "CAST((s_suppkey*104729) % 37001 - 18500 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "horizon": "CAST(s_suppkey % 60 AS INT)",
    "detection": "CASE s_suppkey % 7 WHEN 0 THEN 'all' WHEN 1 THEN 'Fell' WHEN 2 THEN NULL WHEN 3 THEN 'other' "
    "ELSE 'Found' END",
}

_GAZETTEER = {
    "place_id": "c_custkey",
    "country": "n_name",
    "lat": "CAST((c_custkey*6947) % 17001 - 8500 AS DOUBLE) / CAST(100 AS DOUBLE)",
    "lon": "CAST((c_custkey*15485863) % 35801 - 17900 AS DOUBLE) / CAST(100 AS DOUBLE)",
}

_COUNTRY_NAMES = {
    "country": "n_name",
    "country_name": "concat('Country of ', n_name)",
    "iso_alpha": "upper(substr(n_name, 1, 3))",
}

_SELECTION = {"id": "o_orderkey"}
_SELECTED = "o_orderpriority = '1-URGENT'"


def _columns(view: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in view.items()]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*_columns(_RAW_OBS))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_obs(raw_obs(spark, sf_dir), AS_OF_YEAR)


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr(*_columns(_LOCATIONS))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr(*_columns(_PARAMETERS))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr(*_columns(_REQUESTS))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.selectExpr(*_columns(_GAZETTEER))


def country_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").selectExpr(*_columns(_COUNTRY_NAMES))


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").filter(_SELECTED).selectExpr(*_columns(_SELECTION))


def _select(view: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_columns(view))} FROM {source}"


_CLEANED = f"""
    SELECT id, name, coalesce(recclass, 'Unknown') AS recclass, coalesce(fall, 'Unknown') AS fall, reclat, reclong,
        greatest(CASE WHEN m <= 0 THEN mm ELSE m END, CAST(1 AS DOUBLE)) AS mass_g,
        log10(greatest(CASE WHEN m <= 0 THEN mm ELSE m END, CAST(1 AS DOUBLE))) AS log_mass,
        CAST(floor(coalesce(y, 0)) AS INT) AS year, CAST(floor(coalesce(y, 0) / 10) AS INT) * 10 AS decade
    FROM typed CROSS JOIN (
        SELECT min(m) AS mm FROM typed
        WHERE m > 0 AND reclat IS NOT NULL AND reclong IS NOT NULL AND NOT (reclat = 0 AND reclong = 0)) smallest
    WHERE reclat IS NOT NULL AND reclong IS NOT NULL AND m IS NOT NULL AND NOT (reclat = 0 AND reclong = 0)
        AND (y IS NULL OR y BETWEEN 1000 AND {AS_OF_YEAR})"""

_TYPED = """SELECT id, name, recclass, fall, reclat, reclong,
        TRY_CAST(mass_raw AS DOUBLE) AS m, TRY_CAST(year_raw AS DOUBLE) AS y FROM raw_obs"""

# In order of use: later entries may read earlier ones.
VIEWS = {
    "raw_obs": _select(_RAW_OBS, "orders"),
    "typed": _TYPED,
    "obs": _CLEANED,
    "locations": _select(_LOCATIONS, "supplier"),
    "parameters": _select(_PARAMETERS, "supplier"),
    "requests": _select(_REQUESTS, "supplier"),
    "gazetteer": _select(_GAZETTEER, "customer JOIN nation ON c_nationkey = n_nationkey"),
    "country_names": _select(_COUNTRY_NAMES, "nation"),
    "selection": f"{_select(_SELECTION, 'orders')} WHERE {_SELECTED}",
}


def with_views(names: str, body: str) -> str:
    """``body`` (which may open with its own ``, name AS (...)`` entries) behind the named views."""
    wanted = set(names.split())
    if "obs" in wanted:
        wanted |= {"raw_obs", "typed"}
    parts = [f"{name} AS ({text})" for name, text in VIEWS.items() if name in wanted]
    return f"WITH {', '.join(parts)} {body}"
