"""Structured Streaming jobs: ingest, duplicates, progress, throughput, inference."""
