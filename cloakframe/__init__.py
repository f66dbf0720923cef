"""Sensitive-data analytics as Spark DataFrame transformations."""
