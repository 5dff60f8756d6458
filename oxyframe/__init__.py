"""oxyframe: multi-channel sensor time series on Spark DataFrames."""
