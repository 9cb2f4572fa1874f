"""Face-model fitting data as plain Spark DataFrames."""
