"""lodestream: a PySpark-native analytics engine for cost, latency and finding data."""

__version__ = "0.1.0"
