"""Usage accounting for AI coding assistants on Spark DataFrames."""
