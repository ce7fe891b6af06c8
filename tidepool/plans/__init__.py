"""Clustering algorithms as compositions of operators."""
