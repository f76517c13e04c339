"""All queries of the library but those of its corpus subpackage."""

from __future__ import annotations

from . import catalog, changes, domain, packages, relational, reporting, scans, studies

_ALL = domain.ALL | packages.ALL | catalog.ALL | scans.ALL | changes.ALL | studies.ALL | reporting.ALL


def queries() -> dict:
    return relational.queries() | {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | {name: sql for name, (_, sql) in _ALL.items() if sql}
