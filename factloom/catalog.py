"""Registered queries over the reference's operators, and the SQL that checks them."""

from __future__ import annotations

from .plans import base, runs, scores, texts  # noqa: F401  the modules register their queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
