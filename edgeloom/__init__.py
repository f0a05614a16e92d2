"""edgeloom: a PySpark-native engine for large timestamped directed graphs kept as edge tables."""

__version__ = "0.1.0"
