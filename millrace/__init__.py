"""Millrace: operations analytics as PySpark jobs."""
