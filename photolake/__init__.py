"""Photolake: photo-collection analytics on Spark DataFrames."""
