"""Counts over streams."""
