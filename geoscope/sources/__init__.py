from geoscope.sources.catalogue import (
    RAW_SCHEMA,
    read_filtered_json,
    read_obs,
    read_obs_in_place,
    read_raw_csv,
    read_raw_parquet,
    write_filtered_json,
    write_obs,
    write_obs_in_place,
)
from geoscope.sources.gazetteer import GAZETTEER_SCHEMA, read_country_names, read_gazetteer

__all__ = [
    "GAZETTEER_SCHEMA",
    "RAW_SCHEMA",
    "read_country_names",
    "read_filtered_json",
    "read_gazetteer",
    "read_obs",
    "read_obs_in_place",
    "read_raw_csv",
    "read_raw_parquet",
    "write_filtered_json",
    "write_obs",
    "write_obs_in_place",
]
