"""Every query of the library by name, with the SQL that an independent engine can run."""

from . import administration, changes, cleaning, corpus, reports, retrieval, streams

_PARTS = (corpus.registry, cleaning.registry, changes.registry, streams.registry, administration.registry, retrieval.registry, reports.registry)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.queries.items()}
ORACLE_SQL: dict[str, str] = {name: s for part in _PARTS for name, s in part.sql.items()}
