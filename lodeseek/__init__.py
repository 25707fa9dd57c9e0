"""A PySpark-native web-search analytics engine."""
