"""All queries outside the llm subpackage."""

from tallyloom.plans import corpus_queries, ledger_queries, rolling_queries, text_queries

_MODULES = (ledger_queries, corpus_queries, text_queries, rolling_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
