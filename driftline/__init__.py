"""driftline: a Spark-native engine for multi-tenant product event analytics."""

__version__ = "0.1.0"
