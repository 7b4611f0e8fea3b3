"""Streaming and parallel ingest."""
