"""readlens: a PySpark-native analytics engine for base-call accuracy and quality in DNA read data."""

__version__ = "0.1.0"
