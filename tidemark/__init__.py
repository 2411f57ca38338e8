"""tidemark: event-detection analytics on Spark DataFrames."""
