"""Queries on neighbourhoods: zone joins, nearest neighbours, countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoscope.operators import globe, nearest, zones
from geoscope.plans import derived as d
from geoscope.plans.registry import add
from geoscope.plans.staging import country_names, gazetteer, obs, obs_in_place

_PAIR = "obs CROSS JOIN locations"
_DISTANCE = "sqrt((reclat - lat) * (reclat - lat) + (reclong - lon) * (reclong - lon))"
_IN_BOX = "reclat BETWEEN lat - {r} AND lat + {r} AND reclong BETWEEN lon - {r} AND lon + {r}"
_COLUMNS = ["location_id", "id", "recclass", "fall", "reclat", "reclong", "mass_g", "year", "distance"]
_LIST = ", ".join(_COLUMNS[:-1])

add(
    "within_radius",
    lambda s, p: zones.within_radius(obs(s, p), d.locations(s, p), 2.5).select(*_COLUMNS),
    "obs locations",
    f"SELECT {_LIST}, {_DISTANCE} AS distance FROM {_PAIR} WHERE {_DISTANCE} <= 2.5",
)
add(
    "within_box",
    lambda s, p: zones.within_box(obs(s, p), d.locations(s, p), 2.5).select(*_COLUMNS),
    "obs locations",
    f"SELECT {_LIST}, {_DISTANCE} AS distance FROM {_PAIR} WHERE {_IN_BOX.format(r='2.5')}",
)
add(
    "spatial_join_radius",
    lambda s, p: zones.within_radius(obs(s, p), d.parameters(s, p)).select("location_id", "id", "distance"),
    "obs parameters",
    f"SELECT location_id, id, {_DISTANCE} AS distance FROM obs CROSS JOIN parameters WHERE {_DISTANCE} <= radius",
)
add(
    "spatial_join_box",
    lambda s, p: zones.within_box(obs(s, p), d.parameters(s, p)).select("location_id", "id", "distance"),
    "obs parameters",
    f"SELECT location_id, id, {_DISTANCE} AS distance FROM obs CROSS JOIN parameters "
    f"WHERE {_IN_BOX.format(r='radius')}",
)
# One location, as when a point is picked on a map: the middle of all. Of the store in space order only
# pages around it are read.
_MIDDLE = [
    "CAST(0 AS BIGINT) AS location_id",
    "CAST(floor(avg(lat)) AS DOUBLE) AS lat",
    "CAST(floor(avg(lon)) AS DOUBLE) AS lon",
    "CAST(2.5 AS DOUBLE) AS radius",
]


def _middle(s, p):
    return d.locations(s, p).agg(*map(F.expr, _MIDDLE))


for _name, _search, _test in (
    ("within_radius_here", zones.within_radius, f"{_DISTANCE} <= 2.5"),
    ("within_box_here", zones.within_box, _IN_BOX.format(r="2.5")),
):
    add(
        _name,
        lambda s, p, search=_search: search(obs_in_place(s, p), _middle(s, p)).select(*_COLUMNS),
        "obs locations",
        f""", middle AS (SELECT {', '.join(_MIDDLE)} FROM locations)
        SELECT {_LIST}, {_DISTANCE} AS distance FROM obs CROSS JOIN middle WHERE {_test}""",
    )
add(
    "zone_counts_here",
    lambda s, p: zones.zone_summary(zones.coordinate_counts(obs_in_place(s, p)), _middle(s, p)),
    "obs locations",
    f""", middle AS (SELECT {', '.join(_MIDDLE)} FROM locations)
    SELECT location_id, count(*) AS n FROM obs CROSS JOIN middle WHERE {_DISTANCE} <= radius GROUP BY location_id""",
)
add(
    "nearest_distance",
    lambda s, p: nearest.nearest_distance(obs(s, p), d.locations(s, p)),
    "obs locations",
    f"SELECT location_id, min({_DISTANCE}) AS d_min FROM {_PAIR} GROUP BY location_id",
)
add(
    "nearest_place",
    lambda s, p: nearest.nearest_place(obs(s, p), gazetteer(s, p)),
    "obs gazetteer",
    f""", c AS (SELECT reclat, reclong, count(*) AS n FROM obs GROUP BY reclat, reclong),
    b AS (SELECT reclat, reclong, n, min((({_DISTANCE}), place_id, country)) AS best
          FROM c CROSS JOIN gazetteer GROUP BY reclat, reclong, n)
    SELECT reclat, reclong, n, best[2] AS place_id, best[3] AS country, best[1] AS distance FROM b""",
)
add(
    "country_lookup",
    lambda s, p: nearest.country_lookup(gazetteer(s, p), country_names(s, p)),
    "gazetteer country_names",
    "SELECT g.*, country_name, iso_alpha FROM gazetteer g LEFT JOIN country_names c ON g.country = c.country",
)
add("gazetteer_scan", lambda s, p: gazetteer(s, p), "gazetteer", "SELECT * FROM gazetteer")
add(
    "country_counts",
    lambda s, p: nearest.country_counts(obs(s, p), gazetteer(s, p), country_names(s, p)),
    "obs gazetteer country_names",
    f""", b AS (SELECT id, min((({_DISTANCE}), place_id, country)) AS best FROM obs CROSS JOIN gazetteer GROUP BY id),
    k AS (SELECT best[3] AS country, count(*) AS n FROM b GROUP BY 1)
    --result
    SELECT k.country, n, country_name, iso_alpha, log10(n + 1) AS log_n
    FROM k LEFT JOIN country_names c ON c.country = k.country""",
    rounded="log_n",
)
add(
    "zone_counts",
    lambda s, p: zones.zone_summary(zones.coordinate_counts(obs(s, p)), d.parameters(s, p)),
    "obs parameters",
    f"SELECT location_id, count(*) AS n FROM obs CROSS JOIN parameters WHERE {_DISTANCE} <= radius "
    "GROUP BY location_id",
)
add(
    "zone_median_mass",
    lambda s, p: zones.zone_median(obs(s, p), d.parameters(s, p)).withColumn("median", F.col("median")),
    "obs parameters",
    f"SELECT location_id, median(mass_g) AS median FROM obs CROSS JOIN parameters WHERE {_DISTANCE} <= radius "
    "GROUP BY location_id",
    rounded="median",
)

# Great-circle distances, in degrees of arc.
_ARC = (
    "degrees(2 * asin(sqrt(least(1, pow(sin(radians(reclat - lat) / 2), 2) "
    "+ cos(radians(lat)) * cos(radians(reclat)) * pow(sin(radians(reclong - lon) / 2), 2)))))"
)

add(
    "globe_radius",
    lambda s, p: globe.within_radius(obs(s, p), d.parameters(s, p)).select("location_id", "id", "distance"),
    "obs parameters",
    f"SELECT location_id, id, {_ARC} AS distance FROM obs CROSS JOIN parameters WHERE {_ARC} <= radius",
    rounded="distance",
)
# One location on the meridian where longitudes turn over.
_TURN = [
    "CAST(0 AS BIGINT) AS location_id",
    "CAST(floor(avg(lat)) AS DOUBLE) AS lat",
    "CAST(180 AS DOUBLE) AS lon",
    "CAST(10 AS DOUBLE) AS radius",
]
add(
    "globe_radius_here",
    lambda s, p: globe.within_radius(obs_in_place(s, p), d.locations(s, p).agg(*map(F.expr, _TURN))).select("location_id", "id", "distance"),
    "obs locations",
    f""", turn AS (SELECT {', '.join(_TURN)} FROM locations)
    --result
    SELECT location_id, id, {_ARC} AS distance FROM obs CROSS JOIN turn WHERE {_ARC} <= radius""",
    rounded="distance",
)
add(
    "globe_zone_counts",
    lambda s, p: globe.zone_counts(obs(s, p), d.parameters(s, p)),
    "obs parameters",
    f"SELECT location_id, count(*) AS n FROM obs CROSS JOIN parameters WHERE {_ARC} <= radius GROUP BY location_id",
)
add(
    "globe_nearest_distance",
    lambda s, p: globe.nearest_distance(obs(s, p), d.locations(s, p)),
    "obs locations",
    f"SELECT location_id, min({_ARC}) AS d_min FROM {_PAIR} GROUP BY location_id",
    rounded="d_min",
)
