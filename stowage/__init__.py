"""Archive-catalog analytics on Spark DataFrames."""
