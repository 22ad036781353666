"""streaming of the case-linkage engine."""
