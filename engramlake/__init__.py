"""Retrieval and memory analytics as Spark DataFrame operators."""
