"""The queries of the core and, where SQL can express them, their SQL."""

from __future__ import annotations

from docloom.plans import basics, files, more, pages, problems, relational

_CATALOGS = (basics.CATALOG, relational.CATALOG, files.CATALOG, more.CATALOG, pages.CATALOG)


def queries() -> dict:
    return problems.queries() | {name: f for catalog in _CATALOGS for name, (f, _) in catalog.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for catalog in _CATALOGS for name, (_, sql) in catalog.items() if sql}
