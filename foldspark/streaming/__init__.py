"""Projections over streams."""
