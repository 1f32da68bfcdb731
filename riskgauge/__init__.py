"""Selective-classification and split-integrity analytics on Spark DataFrames."""
