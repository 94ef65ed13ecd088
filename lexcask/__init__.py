"""A PySpark-native engine for indexing and searching a corpus of documents."""
