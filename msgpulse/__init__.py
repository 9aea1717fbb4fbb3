"""Message-sentiment analytics on Spark DataFrames."""
