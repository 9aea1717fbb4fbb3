"""Named end-to-end queries over the given tables."""

from __future__ import annotations

from msgpulse.plans import corpus, feeds, sentiment, training  # noqa: F401
from msgpulse.plans.catalogue import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
