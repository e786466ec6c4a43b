"""Whole jobs composed from operators: index refresh, retrieval, dataset build."""
