"""tidewell: a PySpark-native analytics engine for conversation memory."""

__version__ = "0.1.0"
