"""Customer-loyalty analytics on Spark DataFrames."""
