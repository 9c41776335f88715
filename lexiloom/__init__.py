"""Corpus similarity, comparison, search and link-graph analytics on Spark DataFrames."""
