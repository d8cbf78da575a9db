"""Ranked retrieval, budgeted packing and retrieval evaluation on Spark DataFrames."""
