"""Document-retrieval and routing-evaluation analytics on Spark DataFrames."""
