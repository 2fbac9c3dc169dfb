"""Pipelines of several operators, and the query catalogue over the test tables."""
