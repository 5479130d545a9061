"""A PySpark-native engine for word senses in large corpora."""
