"""Incremental ingestion, job running and streaming state."""
