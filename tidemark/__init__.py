"""Point-in-time, cross-sectional and event-time analytics on Spark DataFrames."""
