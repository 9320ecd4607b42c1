"""Interval, vector and timeline analytics on PySpark DataFrames."""
