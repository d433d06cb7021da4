"""Registered queries over the driver's tables, with their DuckDB counterparts."""

from logquarry.plans import files, investigation, masking_queries, parsing, people, reading, timeline

_MODULES = (timeline, parsing, investigation, files, masking_queries, people, reading)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
