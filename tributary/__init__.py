"""Media-stream and real-time-transport analytics on Spark DataFrames."""
