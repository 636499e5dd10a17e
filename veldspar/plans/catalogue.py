"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from veldspar.plans import chunks, data, derived, inputs, relational, reports, retrieval, scalar, stores, streams, writing  # noqa: F401  registers
from veldspar.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
