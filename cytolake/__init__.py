"""Bisulfite-sequencing analytics and corpus building on Spark DataFrames."""
