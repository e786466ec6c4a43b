"""quarry: corpus indexing, retrieval and dataset building as PySpark DataFrame jobs."""

__version__ = "0.1.0"
