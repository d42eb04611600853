"""A knowledge base as Spark jobs: ingest, cleaning, duplicates, indexing, retrieval, usage and streams."""
