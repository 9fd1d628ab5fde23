"""Foliant: corpus analytics on PySpark DataFrames."""
