"""Plumbline: econometrics and causal inference on Spark DataFrames."""
