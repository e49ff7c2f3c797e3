"""Transit map matching, spatial and schedule analytics as Spark DataFrames."""
