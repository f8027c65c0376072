"""Investigation analytics on Spark DataFrames."""
