"""operators of the case-linkage engine."""
