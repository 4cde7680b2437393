"""Streaming forms over append-only samples."""
