"""stratavox: Spark-native analytics for chunked volumes and the object tables derived from them."""

__version__ = "0.1.0"
