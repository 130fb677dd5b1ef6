"""All queries of the engine: importing this module registers them."""

from millrace.plans import item_queries, queries, reader_queries, record_queries  # noqa: F401  registers
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
