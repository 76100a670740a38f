"""All registered queries of the document engine and their SQL."""

from . import catalog_queries, chain_queries, fold_queries, graph_queries, ledger_queries, queries, search_queries

MODULES = (queries, catalog_queries, search_queries, graph_queries, ledger_queries, fold_queries, chain_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
