"""Relational operators over catalogs, libraries, queues and logs."""
