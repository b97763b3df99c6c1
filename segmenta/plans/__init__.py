"""Named queries (``registry.QUERIES``) and their DuckDB oracles (``registry.ORACLES``)."""
