"""The same ingestion on streams."""
