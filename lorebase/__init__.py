"""lorebase: a PySpark-native engine for document retrieval and learning analytics."""

__version__ = "0.1.0"
