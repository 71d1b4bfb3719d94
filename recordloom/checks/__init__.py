"""Queries over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from recordloom.checks import converting, exploring, matching, merging, profiling, projecting, resolving, sourcing

_MODULES = (exploring, merging, sourcing, profiling, resolving, matching, projecting, converting)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in _MODULES for name, text in module.SQL.items()}
