"""Review and text analytics on Spark DataFrames."""
