"""Algorithms that drive batches of operators."""
