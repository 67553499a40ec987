"""Memory retrieval and log analytics on Spark DataFrames."""
