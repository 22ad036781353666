"""A PySpark-native analytics engine that links case records."""
