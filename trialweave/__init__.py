"""Trial-log analytics on Spark DataFrames."""
