"""Similarity search and near-duplicate detection on Spark DataFrames."""
