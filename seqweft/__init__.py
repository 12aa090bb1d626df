"""Sequence-corpus, listing-crawl and training-data operators on Spark DataFrames."""
