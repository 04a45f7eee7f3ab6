"""A PySpark-native engine for page-grain document extraction quality."""
