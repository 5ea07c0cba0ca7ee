"""Retrieval pipelines as DataFrame-to-DataFrame operators on Spark SQL."""
