"""Weather time-series analytics on Spark DataFrames, for many locations at once."""
