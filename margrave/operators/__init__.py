"""Counting, information-theoretic tests, Bayesian networks."""
