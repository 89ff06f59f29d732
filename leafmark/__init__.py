"""Document search and analytics on Spark DataFrames."""
