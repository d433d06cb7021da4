"""Queries of the training-data operators and the SQL for those that SQL can express."""

from logquarry.llm import bpe, decontaminate, filter_audit, language_id, language_model, periodic_runs, pii, quality_model, quality_rules, simhash, substrings, token_counts, token_files

_MODULES = (simhash, token_files, token_counts, substrings, decontaminate, pii, quality_model, quality_rules, bpe, language_model, periodic_runs, filter_audit, language_id)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
