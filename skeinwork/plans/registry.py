"""All queries of the core, by name."""

from __future__ import annotations

from skeinwork.plans import packed, queries

QUERIES = {**packed.QUERIES, **queries.QUERIES}
SQL = {**packed.SQL, **queries.SQL}
FLAGSHIP = queries.search_ranked
