"""All queries of the core by name, with the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import detail, records, scope, upkeep, views

FLAGSHIP = "suburb_overview"
_MODULES = [records, views, upkeep, detail, scope]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
