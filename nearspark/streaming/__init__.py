"""Structured Streaming: training in micro-batches."""
