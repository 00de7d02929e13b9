"""Queries over the shared test tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

from corpusaudit.checks.registry import QUERIES, Query

SUBJECTS = ["web", "conversations", "layouts", "intake", "leftovers", "catalogs", "crawlers", "consent", "terms", "measures", "tables", "flows", "scalars"]


def load_queries() -> dict[str, Query]:
    for subject in SUBJECTS:
        import_module(f"corpusaudit.checks.{subject}")
    return dict(QUERIES)
