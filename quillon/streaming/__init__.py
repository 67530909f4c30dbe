"""Clustering of streams."""
