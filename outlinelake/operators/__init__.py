"""operators of the outline engine."""
