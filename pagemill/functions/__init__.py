"""Column -> Column helpers (text, URL and HTML expressions)."""
