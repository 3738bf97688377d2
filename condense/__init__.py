"""A PySpark-native engine for large collections of machine-generated text."""
