"""stancelake: a PySpark-native engine for document-derived stance and entity analytics."""

__version__ = "0.1.0"
