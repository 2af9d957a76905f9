"""palimpsest: a PySpark-native engine for retrieval and memory analytics."""
