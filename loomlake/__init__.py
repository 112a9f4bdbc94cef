"""Retrieval, document and event analytics as Spark jobs."""
