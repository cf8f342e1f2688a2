"""A PySpark-native engine for page-oriented document records."""
