"""Commercial pricing analytics on Spark DataFrames."""
