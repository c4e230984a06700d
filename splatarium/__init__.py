"""Splat-scene analytics on Spark: every operation is a DataFrame plan."""
