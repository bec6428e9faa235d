"""Plan helpers: durable cuts of lineage, the query catalogue."""
