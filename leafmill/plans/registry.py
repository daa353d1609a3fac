"""All queries of the library by name."""

from __future__ import annotations

from leafmill.plans import book_queries, catalog_queries, storage_queries, streaming_queries, structure_queries, text_queries
from leafmill.plans.base import Query

QUERIES: dict[str, Query] = {**text_queries.QUERIES, **structure_queries.QUERIES, **catalog_queries.QUERIES, **book_queries.QUERIES, **streaming_queries.QUERIES, **storage_queries.QUERIES}
