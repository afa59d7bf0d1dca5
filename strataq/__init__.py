"""A PySpark-native engine for memory-style retrieval and analytics."""
