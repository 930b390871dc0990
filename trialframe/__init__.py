"""Analytics of multi-round trials on Spark DataFrames."""
