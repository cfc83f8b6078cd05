"""All queries of the library (the optional subpackage aside), by name, and their SQL."""

from __future__ import annotations

from . import algebra_queries, annotation_queries, dataset_queries, more_queries, segment_queries, sidecar_queries, stats_queries, temporal_queries, text_queries, vector_queries, whole_text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
