"""A PySpark-native hybrid retrieval and analytics engine."""
