"""Streaming warehouse jobs and training-text operators on PySpark."""
