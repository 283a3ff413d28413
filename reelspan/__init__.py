"""Recording analytics on Spark: time-coded recordings as DataFrames."""
