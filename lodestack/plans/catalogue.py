"""All queries of the library outside lodestack.llm."""

from __future__ import annotations

from . import aggregates, checks, documents, evaluation, inputs, joins, layout, ranking, retrieval  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
