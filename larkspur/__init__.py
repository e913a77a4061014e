"""larkspur: a typed, immutable query builder that lowers to Spark DataFrames."""
