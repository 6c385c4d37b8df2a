"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from folium.plans import catalog_queries, import_queries, library_queries, order_queries, upkeep_queries

QUERIES = catalog_queries.Q | library_queries.Q | upkeep_queries.Q | order_queries.Q | import_queries.Q
ORACLES: dict[str, str] = catalog_queries.S | library_queries.S | upkeep_queries.S | order_queries.S | import_queries.S
