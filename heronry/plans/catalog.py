"""All registered queries."""

from __future__ import annotations

from heronry.plans import events, graph, retrieval, service, text  # noqa: F401  registers its queries
from heronry.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
