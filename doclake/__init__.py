"""doclake: document-library ingest, quality and search as Spark DataFrame jobs."""
