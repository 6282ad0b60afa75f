"""All queries by name, with their oracles."""

from __future__ import annotations

from plumbline.plans import curation, landmarks, metrics, parsing, relational  # noqa: F401
from plumbline.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
