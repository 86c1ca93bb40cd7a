"""A PySpark-native analytics engine for command-line documentation."""

__version__ = "0.1.0"
