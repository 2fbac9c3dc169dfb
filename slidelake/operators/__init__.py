"""Operators over slide, tile, annotation, cell and status tables."""
