"""All registered queries of the library."""

from __future__ import annotations

from harrier.plans import mechanism_queries, ops_queries, record_queries, retrieval_queries, star_queries
from harrier.plans.registry import Query

PARTS = (retrieval_queries.Q, star_queries.Q, ops_queries.Q, record_queries.Q, mechanism_queries.Q)


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.queries.items()}


def sql() -> dict[str, str]:
    return {name: s for part in PARTS for name, s in part.sql.items()}
