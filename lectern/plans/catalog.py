"""All registered queries; importing the modules fills the registry."""

from lectern.plans import (  # noqa: F401
    document_queries,
    pipeline_queries,
    question_queries,
    search_queries,
    training_queries,
)
from lectern.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
