"""Document analytics and hybrid retrieval as Spark DataFrames."""
