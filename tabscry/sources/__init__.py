"""Relations, catalog listings, file ingest and publishing of results."""
