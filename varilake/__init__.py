"""Genotype analytics and table quality on Spark DataFrames."""
