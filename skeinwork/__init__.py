"""skeinwork: a PySpark-native engine for building and querying a web-search corpus."""

__version__ = "0.1.0"
