"""All named queries of the core, and their SQL twins."""

from __future__ import annotations

from . import evaluation, graph, intervals, nested, units

_MODULES = [evaluation, graph, intervals, nested, units]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
