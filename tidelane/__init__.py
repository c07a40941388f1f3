"""Traffic-speed and congestion analysis on Spark DataFrames."""
