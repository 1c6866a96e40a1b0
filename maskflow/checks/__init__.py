"""Registered queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from maskflow.checks.base import ORACLES, QUERIES, Query


def _load() -> None:
    from maskflow.checks import generate_checks, job_checks, mask_checks, profile_checks, redact_checks, source_checks  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
