"""streaming of the outline engine."""
