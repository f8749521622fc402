"""tidemark: a Spark-native analytics engine for versioned regional data."""

__version__ = "0.1.0"
