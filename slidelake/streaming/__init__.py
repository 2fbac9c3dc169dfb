"""Continuous forms of the viewport, edit, ingest and status jobs."""
