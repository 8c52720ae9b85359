"""Table sources, request validation and sinks."""
