"""stridex: positional data-parallel operators on Spark DataFrames."""
