"""All queries of the library proper."""

from lodestone.plans import answering, answers, decisions, domains, hierarchies, mappings, retrieval, structured, texts  # noqa: F401
from lodestone.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
