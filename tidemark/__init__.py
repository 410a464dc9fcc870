"""Time-series signal analytics and table operators on Spark DataFrames."""
