"""sources of the case-linkage engine."""
