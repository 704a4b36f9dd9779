"""casegrain: a PySpark-native engine for document analytics and hybrid case retrieval."""
