"""Access-log and endpoint-inventory analytics on Spark DataFrames."""
