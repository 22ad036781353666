"""functions of the case-linkage engine."""
