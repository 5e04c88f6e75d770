"""plans of the outline engine."""
