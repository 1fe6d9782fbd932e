"""pulsegrid: time-series event and state analytics on Spark DataFrames."""
