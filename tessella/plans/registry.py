"""The registered queries and their SQL."""

from __future__ import annotations

from . import extra_queries, fit_queries, fusion_queries, more_queries, null_queries, record_queries, space_queries, study_queries, wave_queries, window_queries  # noqa: F401  register their queries
from .queries import ORACLES, QUERIES

FLAGSHIP = "border_k"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
