"""A SQL table engine and a set of corpus operators, built on Spark DataFrames."""
