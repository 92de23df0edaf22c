"""Promptloom: large prompt batches as Spark DataFrame and Structured Streaming jobs."""
