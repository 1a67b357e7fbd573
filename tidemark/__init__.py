"""Mergeable time-series rollups on Spark."""
