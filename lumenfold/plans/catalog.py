"""All registered queries over the driver's tables."""

from __future__ import annotations

from lumenfold.plans import job_queries, match_queries, more_queries, report_queries, rule_queries, source_queries, stream_queries, text_queries  # noqa: F401  they register themselves
from lumenfold.plans.registry import ORACLES, QUERIES

ENTRY = QUERIES["invoice_summary"]
__all__ = ["ENTRY", "ORACLES", "QUERIES"]
