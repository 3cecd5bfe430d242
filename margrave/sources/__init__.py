"""Dataset sources."""
