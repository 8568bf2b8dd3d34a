"""Set-at-a-time analytics over feeds of official notices, on Spark DataFrames."""
