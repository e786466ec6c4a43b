"""Structured Streaming jobs over change logs and token lines."""
