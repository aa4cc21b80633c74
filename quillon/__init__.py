"""Record processing and corpus preparation on Spark DataFrames."""
