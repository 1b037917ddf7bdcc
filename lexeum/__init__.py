"""A PySpark-native engine for annotated text corpora."""
