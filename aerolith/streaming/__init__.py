"""Structured Streaming: file ingest and Type-2 history kept up to date."""
