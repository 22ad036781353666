"""plans of the case-linkage engine."""
