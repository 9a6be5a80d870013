"""Spark-first news retrieval analytics."""
