"""File-by-file ingest with Structured Streaming."""
