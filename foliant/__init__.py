"""foliant: a Spark-native engine for governed document corpora."""

__version__ = "0.1.0"
