"""Signal analytics on Spark: ordered multi-channel signals as DataFrames."""
