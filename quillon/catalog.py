"""All queries of the library, without the corpus operators."""

from __future__ import annotations

from quillon.plans.queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
