"""PySpark-native engine for matching, reconciling and versioning book metadata."""
