"""Dependency analysis and Markov-boundary discovery on Spark DataFrames."""
