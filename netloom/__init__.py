"""netloom: network analytics on Spark DataFrames."""
