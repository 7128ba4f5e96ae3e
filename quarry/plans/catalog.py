"""Every query of the engine and its SQL."""

from __future__ import annotations

from quarry.plans import communities, corpus, graphs, library, ops, retrieval, search

QUERIES = {**retrieval.R.queries, **search.R.queries, **communities.R.queries, **graphs.R.queries, **corpus.R.queries, **ops.R.queries, **library.R.queries}
SQL = {**retrieval.R.sql, **search.R.sql, **communities.R.sql, **graphs.R.sql, **corpus.R.sql, **ops.R.sql, **library.R.sql}
