"""Retrieval and media-index analytics as Spark jobs."""
