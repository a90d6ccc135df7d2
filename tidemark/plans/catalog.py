"""All queries over the reference's domain, by importing the modules that register them."""

from __future__ import annotations

from tidemark.plans import macro, market, messages, reactions, records, stored, vendors, workflow, visible, parts, research, named  # noqa: F401, I001 - visible takes up what the others registered
from tidemark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
