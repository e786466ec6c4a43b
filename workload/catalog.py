"""All registered queries."""

from workload import chat, corpus, dataset, retrieval, streams  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
