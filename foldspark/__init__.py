"""A projection engine over event logs, on Spark DataFrames."""
