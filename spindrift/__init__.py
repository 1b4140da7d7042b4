"""Retrieval and text analytics as PySpark DataFrame operators."""
