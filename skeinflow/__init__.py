"""skeinflow: a PySpark-native engine for indexing, ranking and packing text and code."""

__version__ = "0.1.0"
