"""matchforge: match-and-rank analytics on Spark DataFrames."""
