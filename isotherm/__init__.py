"""A PySpark-native engine for gridded climate analytics."""
