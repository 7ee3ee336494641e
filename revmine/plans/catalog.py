"""All query plans outside ``llm`` and their DuckDB twins."""

from __future__ import annotations

from . import dataset_queries, evaluation_queries, ingest_queries, io_queries, retrieval_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "knn_feedback"
