"""quillon: a PySpark-native analytics engine built on DataFrames, Spark SQL and Structured Streaming."""

__version__ = "0.1.0"
