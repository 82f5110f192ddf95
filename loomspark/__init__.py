"""Curating, auditing and scoring datasets of functions as graphs, on Spark DataFrames."""
