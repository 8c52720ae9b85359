"""Structured Streaming forms of the extraction and task-state operators."""
