"""Analytics for large catalogues of geolocated, dated observations, on Spark DataFrames."""
