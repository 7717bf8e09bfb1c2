"""Spark-first operators for monitoring, normalising and curating collected records."""
