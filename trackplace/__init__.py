"""Track and photo-placement analytics on Spark DataFrames."""
