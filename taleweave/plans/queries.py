"""Registered queries of the core and their SQL."""

from taleweave.plans import graphs, library, records, retrieval, text

MODULES = (text, retrieval, records, graphs, library)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
FLAGSHIP = "hybrid_search"
