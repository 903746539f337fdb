"""Concordia: semantic data integration and data-quality analytics on Spark DataFrames."""
