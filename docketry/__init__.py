"""Document intelligence for court judgments on Spark DataFrames."""
