"""PySpark-native analytics over regulatory filing text."""

__version__ = "0.1.0"
