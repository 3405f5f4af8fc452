"""Trial-structured signal analytics on Spark DataFrames."""
