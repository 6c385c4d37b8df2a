"""Catalog analytics on Spark: search, entity resolution, library and queue queries, page queries and streams."""
