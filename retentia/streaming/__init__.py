"""Structured Streaming jobs: file-stream sources, idempotent foreachBatch sinks, windowed throughput."""
