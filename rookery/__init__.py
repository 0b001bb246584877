"""Rookery: social-feed analytics as PySpark DataFrame pipelines."""
