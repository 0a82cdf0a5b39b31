"""Regular path queries and sparse Boolean relations on Spark DataFrames."""
