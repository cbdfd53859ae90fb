"""Reconciliation analytics on Spark DataFrames."""
