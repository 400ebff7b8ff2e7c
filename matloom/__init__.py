"""A PySpark-native engine for composition-based materials datasets."""
