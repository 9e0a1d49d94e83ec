"""Incremental, dimensional data processing on Spark."""
