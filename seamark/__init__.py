"""Event, graph and geo-temporal analytics on Spark DataFrames."""
