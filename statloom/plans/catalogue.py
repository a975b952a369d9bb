"""All named queries over the star-schema tables, with the SQL each must agree with."""

from __future__ import annotations

from statloom.plans import domain_queries, estimator_queries, model_queries, tests_queries  # noqa: F401  (they register their queries)
from statloom.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
