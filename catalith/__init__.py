"""Media-catalog analytics on Spark DataFrames."""
