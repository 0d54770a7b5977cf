"""Batch document retrieval and corpus preparation on Spark."""
