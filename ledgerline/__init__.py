"""Software-inventory analytics on Spark DataFrames."""
