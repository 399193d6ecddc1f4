"""Equity-market analytics as Spark jobs: every function takes and returns DataFrames."""
