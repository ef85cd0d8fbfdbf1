"""A PySpark-native memory retrieval and data-preparation engine."""

__version__ = "0.1.0"
