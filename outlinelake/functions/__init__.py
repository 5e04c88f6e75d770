"""functions of the outline engine."""
