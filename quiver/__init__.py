"""Property graphs on Spark: queries in a graph language become DataFrames."""
