"""quire: a Spark-native engine for layered long-form text."""

__version__ = "0.1.0"
