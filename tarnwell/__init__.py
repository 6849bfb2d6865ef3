"""PySpark-native retrieval analytics."""
