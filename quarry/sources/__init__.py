"""Readers and writers that turn outside data into DataFrames."""
