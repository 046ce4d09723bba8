"""A PySpark-native engine for code intelligence and text analytics."""
