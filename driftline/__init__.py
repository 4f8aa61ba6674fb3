"""driftline: network-performance analytics on Spark DataFrames."""
