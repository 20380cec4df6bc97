"""Fund-flow analytics on Spark DataFrames."""
