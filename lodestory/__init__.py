"""News and model-registry analytics on Spark DataFrames, SQL and Structured Streaming."""
