"""Typed-graph fact analytics on Spark."""
