"""framelode: a PySpark-native analytics engine for temporal annotation data."""

__version__ = "0.1.0"
