"""Document-condensation analytics on Spark DataFrames."""
