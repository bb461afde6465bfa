"""Document analytics and catalog queries on Spark DataFrames."""
