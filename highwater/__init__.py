"""Flood-risk and trip-safety analytics on Spark DataFrames."""
