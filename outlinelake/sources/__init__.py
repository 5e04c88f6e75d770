"""sources of the outline engine."""
