"""All registered queries of the trace library."""

from __future__ import annotations

from spanloom.plans import attribution, chrome, metrics, more, reports, timeline  # noqa: F401
from spanloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
